"""The registered queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from tidemark.plans import collection, collection_oracle, oracle, queries, structure, structure_oracle, studies, studies_oracle, zones, zones_oracle

QUERIES = {f.__name__: f for f in (*queries.ALL, *studies.ALL, *structure.ALL, *collection.ALL, *zones.ALL)}
ORACLES = oracle.ORACLES | studies_oracle.ORACLES | structure_oracle.ORACLES | collection_oracle.ORACLES | zones_oracle.ORACLES
