"""Column expressions: saturation, logits, registrable domains, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of two labels.
SUFFIXES = (
    "ac.id", "ac.in", "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th",
    "co.uk", "co.ve", "co.za", "com.ar", "com.au", "com.bd", "com.br", "com.cn", "com.co", "com.eg", "com.hk",
    "com.lk", "com.mx", "com.my", "com.ng", "com.np", "com.pe", "com.ph", "com.pk", "com.ru", "com.sa", "com.sg",
    "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "edu.in", "firebaseapp.com", "firm.in", "gen.in",
    "github.io", "gitlab.io", "go.jp", "gov.au", "gov.cn", "gov.in", "gov.uk", "herokuapp.com", "in.th", "ind.in",
    "me.uk", "ne.jp", "net.au", "net.cn", "net.in", "net.nz", "net.uk", "netlify.app", "nic.in", "or.id", "or.jp",
    "org.au", "org.cn", "org.in", "org.nz", "org.uk", "org.za", "pages.dev", "res.in", "sch.uk", "vercel.app",
    "web.app", "workers.dev",
)
#: Keyword rules in order; the first that matches decides.
RULES = (
    ("suffix", ".gov.in", "government"), ("suffix", ".nic.in", "government"), ("suffix", ".gov.uk", "government"), ("suffix", ".gov.au", "government"),
    ("suffix", ".gov", "government"), ("suffix", ".mil", "government"), ("suffix", ".edu.in", "learning"), ("suffix", ".ac.in", "learning"),
    ("suffix", ".ac.uk", "learning"), ("suffix", ".edu.au", "learning"), ("suffix", ".edu", "learning"), ("contains", "school", "learning"),
    ("contains", "college", "learning"), ("contains", "university", "learning"), ("contains", "academy", "learning"), ("contains", "bank", "finance"),
    ("contains", "insur", "finance"), ("contains", "news", "news"), ("contains", "hotel", "travel"), ("contains", "resort", "travel"),
    ("contains", "realty", "property"), ("contains", "realestate", "property"), ("contains", "recruit", "work"), ("contains", "careers", "work"),
)


def saturate(x: Column, scale: float) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("saturate needs a value of 0 or more")).cast("double")).otherwise(x / (x + scale))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.ln(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))


def median_of(values: Column) -> Column:
    """Median of an array; null if empty."""
    s, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = 2 * F.pi() * x / period
    return F.sin(angle), F.cos(angle)


def registrable_domain(url: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registrable domain of a web URL; null for others, addresses, local and single-label hosts."""
    authority = F.regexp_extract(url, r"^(?i:https?)://([^/?#\\]*)", 1)
    bare = F.regexp_replace(F.lower(authority), "^.*@", "")
    name = F.regexp_replace(F.regexp_replace(bare, r":\d*$", ""), r"^\.+|\.+$", "")
    labels, n = F.split(name, r"\."), F.size(F.split(name, r"\."))
    two = F.array_join(F.slice(labels, -2, 2), ".")
    public = two.isin(*suffixes)
    local = (name == "localhost") | name.endswith(".localhost") | name.rlike(r"^\d+\.\d+\.\d+\.\d+$") | name.contains(":") | name.startswith("[")
    return F.when(
        ~local & (n >= 2) & ~F.array_contains(labels, ""), F.when(~public, two).when(n >= 3, F.array_join(F.slice(labels, -3, 3), "."))
    )


def rule_category(domain: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for kind, value, category in reversed(rules):
        out = F.when(domain.endswith(value) if kind == "suffix" else domain.contains(value), category).otherwise(out)
    return out


def resolve(
    domain: Column, override: Column | None = None, mapped: Column | None = None, rules: tuple[tuple[str, str, str], ...] | None = None
) -> tuple[Column, Column]:
    """(category, source): an override, the map, the first matching rule, else ``unknown``; '' overrides nothing."""
    null = F.lit(None).cast("string")
    override, mapped = F.nullif(null if override is None else override, F.lit("")), null if mapped is None else mapped
    rule = rule_category(F.lower(F.trim(domain)), RULES if rules is None else rules)
    source = F.when(override.isNotNull(), "override").when(mapped.isNotNull(), "map").when(rule.isNotNull(), "rule").otherwise("unknown")
    return F.coalesce(override, mapped, rule, F.lit("unknown")), source


def arrival_flags(transition: Column) -> tuple[Column, Column, Column]:
    """(typed, bookmark, link): how a visit came about, each 0 or 1, from its transition's name."""
    core = F.lower(transition)
    return tuple(x.cast("double") for x in (core.isin("typed", "generated", "keyword"), core.contains("bookmark"), core == "link"))
