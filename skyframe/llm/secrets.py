"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans are regular-expression matches in the whole text. The method adds
weak candidates - key-like strings and endpoints - and reports them only where
a complementary part stands within ``scope`` code points: a key needs an access
identifier or an endpoint, an endpoint needs an access identifier or a secret.
That is an interval join of parts within a document, as an equi-join on scope
cells with a distance condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Weak candidates.
KEY = "[A-Za-z0-9+/]{16,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"
#: Names by kind number; base kinds come first, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "key", "endpoint")
SCOPE = 256
_SPANS = "array<struct<s:int,kind:int,e:int>>"


def _matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """Leftmost non-overlapping matches that ``keep`` accepts, as (s, kind, e) in code points, end exclusive.

    ``split`` gives what lies between the matches of ``regexp_extract_all``, so
    running lengths give the places.
    """
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        s = acc["at"] + F.char_length(piece["gap"])
        e = s + F.coalesce(F.char_length(piece["hit"]), F.lit(0))
        span = F.array(F.struct(s.alias("s"), F.lit(kind).alias("kind"), e.alias("e"))).cast(_SPANS)
        return F.struct(
            e.alias("at"),
            F.when(piece["hit"].isNotNull() & keep(piece["hit"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step)["out"]).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns by start, then kind."""
    return F.array_sort(
        F.concat(
            _matches(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
            _matches(text, ACCESS, 1, lambda m: F.lit(True)),
            _matches(text, HEX, 2, lambda m: F.lit(True)),
        )
    )


def weak_spans(text: Column) -> Column:
    """Key-like strings (letters and digits mixed) and endpoints, before linking."""
    return F.concat(
        _matches(text, KEY, 3, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")),
        _matches(text, ENDPOINT, 4, lambda m: F.lit(True)),
    )


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs: doc_id, text_key (hash of the text), base and spans (arrays of (s, kind, e)).

    ``base``: the base spans; ``spans``: these and the linked weak ones. A null
    text is empty; repeated rows and rows without id are scanned alike (parts
    are linked within rows of the same id and text). Other columns play no part.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    parts = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("text_key"), base_spans(body).alias("base"), weak_spans(body).alias("weak")
    )
    overlaps = lambda w: F.exists("base", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"]))
    parts = materialize(parts.withColumn("weak", F.filter("weak", lambda w: ~overlaps(w))), "secrets")

    linked = _linked(parts, scope).groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("linked"))
    return (
        parts.alias("p")
        .join(linked.alias("l"), F.expr("p.text_key = l.text_key and p.doc_id <=> l.doc_id"), "left")
        .select(
            "p.doc_id",
            "p.text_key",
            "p.base",
            F.array_sort(F.concat("p.base", F.coalesce("l.linked", F.array().cast(_SPANS)))).alias("spans"),
        )
    )


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The interval join: weak spans with a complementary part within ``scope`` of their start."""
    some = parts.where(F.size("weak") > 0)
    weak = some.select("doc_id", "text_key", F.explode("weak").alias("span")).withColumn(
        "cell", F.expr(f"span.s div {scope}")
    )
    others = some.select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("part")).withColumn(
        "cell", F.explode(F.expr(f"transform(array(-1, 0, 1), d -> part.s div {scope} + d)"))
    )
    return weak.alias("w").join(
        others.alias("o"),
        F.expr(
            f"w.text_key = o.text_key and w.doc_id <=> o.doc_id and w.cell = o.cell and abs(w.span.s - o.part.s) <= {scope} and "
            "((w.span.kind = 3 and o.part.kind in (1, 4)) or (w.span.kind = 4 and o.part.kind in (0, 1, 2, 3)))"
        ),
        "left_semi",
    )


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def op4_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return scan_secrets(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with the text between secrets kept and each (merged) secret span replaced by ``mask``.

    Rows and columns stay, whatever the columns' names; a null text stays null.
    Repeated rows, and rows without id, are masked alike. Weak candidates go
    only where they are linked. No rows give no rows.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = scan_secrets(docs, doc_id, text).where(F.size("spans") > 0).select("doc_id", "text_key", "spans").distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(body).alias("key"))
    same = (F.col("d.key") == F.col("f.text_key")) & F.col("d.row").getField(doc_id).eqNullSafe(F.col("f.doc_id"))
    joined = held.alias("d").join(found.alias("f"), same, "left")
    source = F.col("d.row").getField(text)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        clear = F.when(x["s"] > acc["at"], F.substr(source, acc["at"] + 1, x["s"] - acc["at"])).otherwise("")
        shown = F.when((x["s"] >= acc["at"]) & (x["e"] > acc["at"]), F.lit(mask)).otherwise("")
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], clear, shown).alias("out"))

    cut = F.aggregate("f.spans", zero, step)
    clean = F.when(F.col("f.spans").isNull(), source).otherwise(F.concat(cut["out"], F.substr(source, cut["at"] + 1)))
    return joined.select(*[(clean if c == text else F.col("d.row").getField(c)).alias(c) for c in docs.columns])


def _duck(pattern: str, kind: int, keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    return (
        f"SELECT r, {kind} AS kind, s, s + len(m) AS e FROM (SELECT r, m, (sum(len(g)) OVER (PARTITION BY r ORDER BY i) + "
        f"coalesce(sum(len(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::int AS s "
        f"FROM (SELECT r, unnest(regexp_split_to_array(t, '{p}')[1:len(ms)]) AS g, unnest(ms) AS m, unnest(generate_series(1, len(ms))) AS i "
        f"FROM (SELECT r, t, regexp_extract_all(t, '{p}') AS ms FROM d) WHERE len(ms) > 0)) WHERE {keep}"
    )


_ASSIGN_SQL = ASSIGN.replace("'", "''")
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_duck(ASSIGN, 0, f"len(regexp_extract(m, '{_ASSIGN_SQL}', 2)) >= 6")} UNION ALL {_duck(ACCESS, 1)} UNION ALL {_duck(HEX, 2)}),
weak0 AS ({_duck(KEY, 3, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")} UNION ALL {_duck(ENDPOINT, 4)}),
weak AS (SELECT * FROM weak0 w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.e AND w.s < b.e)),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
linked AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM parts o WHERE o.r = w.r AND abs(w.s - o.s) <= {SCOPE}
  AND ((w.kind = 3 AND o.kind IN (1, 4)) OR (w.kind = 4 AND o.kind IN (0, 1, 2, 3))))),
named AS (SELECT *, ({list(KINDS)!r})[kind + 1] || ':' || s || ':' || e AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM linked)),
g AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2,
  string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS b, string_agg(x, ',' ORDER BY s, kind) AS a FROM named GROUP BY r)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN g USING (r)
"""
