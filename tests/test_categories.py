"""Category maps and suffix lists: validation, layers, and names in any case."""

import json

import pytest

from tidemark.functions.columns import registrable_domain
from tidemark.sources import categories

GOOD = {
    "version": 3, "categories": {"news": "News", "work": "Work", "own": "Own"}, "domains": {"Paper.example": "news", "desk.example": "work"},
    "rules": [{"kind": "contains", "value": "JOB", "category": "work"}, {"kind": "suffix", "value": ".press", "category": "news"}],
}


def written(tmp_path, document, name="map.json"):
    path = tmp_path / name
    path.write_text(json.dumps(document, indent=1))
    return f"file://{path}"


def test_map_and_layers(spark, tmp_path):
    made = categories.load_category_map(spark, written(tmp_path, GOOD))
    assert made.version == 3 and made.rules == (("contains", "job", "work"), ("suffix", ".press", "news"))
    rows = [(1, " PAPER.example "), (1, "desk.example"), (2, "desk.example"), (3, "desk.example"), (1, "jobs.press"), (1, "x.press"), (1, "nothing.example"), (1, None)]
    df = spark.createDataFrame(rows, "person_id long, domain string")
    own = spark.createDataFrame([(1, "Desk.example", "own"), (3, "desk.example", "")], "person_id long, domain string, category string")
    got = {(r.person_id, r.domain): (r.category, r.layer) for r in categories.categorised(df, made.domains, own, made.rules).collect()}
    assert got == {
        (1, " PAPER.example "): ("news", "map"), (1, "desk.example"): ("own", "override"), (2, "desk.example"): ("work", "map"),
        (3, "desk.example"): ("work", "map"), (1, "jobs.press"): ("work", "rule"), (1, "x.press"): ("news", "rule"),
        (1, "nothing.example"): ("unknown", "unknown"), (1, None): ("unknown", "unknown"),
    }


@pytest.mark.parametrize(("change", "message"), [
    ({"version": None}, "missing required keys"), ({"domains": None}, "missing required keys"), ({"domains": {"a.example": "else"}}, "undefined categories"),
    ({"rules": [{"kind": "regex", "value": "x", "category": "news"}]}, "unsupported rule kinds"),
    ({"rules": [{"kind": "suffix", "value": "x", "category": "else"}]}, "undefined categories"),
])
def test_malformed_maps_raise(spark, tmp_path, change, message):
    document = {k: v for k, v in (GOOD | change).items() if v is not None}
    with pytest.raises(ValueError, match=message):
        categories.load_category_map(spark, written(tmp_path, document))


def test_suffixes(spark, tmp_path):
    own = categories.load_suffixes(spark, written(tmp_path, {"multiPartSuffixes": ["Co.Example", "co.example"]}))
    assert own == ("co.example",)
    url = spark.createDataFrame([("https://www.shop.co.example/x",)], "url string")
    assert url.select(registrable_domain(url.url, own)).first()[0] == "shop.co.example"
    assert url.select(registrable_domain(url.url)).first()[0] == "co.example"
    with pytest.raises(ValueError, match="multiPartSuffixes"):
        categories.load_suffixes(spark, written(tmp_path, {"multiPartSuffixes": []}))
