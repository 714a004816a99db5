"""Secret scans with multipart credential linking, in DataFrame operations.

Certain kinds (assigned passwords and tokens, access identifiers, long hex
runs) are reported wherever they stand.  Weak candidates (a login or client
name, a random-looking string, an endpoint) are everyday text alone; they are
reported only where complementary parts meet in one scope: a name needs a
secret, a secret needs a name, and an endpoint needs both.  The interval join
of candidates with parts within ``scope`` characters that don't overlap them is made
with running bounds over a document's starts and ends in order of position, so no
pairs are made and the work is linear in the number of matches.

A match's position comes from the pieces of text between the matches: the text
is split at them and the lengths are summed up.  Positions are code points,
ends exclusive.

Edge cases: null and empty texts have no spans; repeated rows are documents of
their own; empty tables give no rows; only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 200


@dataclass(frozen=True)
class Kind:
    """A pattern: ``part`` is what it contributes to a credential, ``base`` kinds
    are reported alone, ``test`` keeps or drops a match (Java pattern on it)."""
    name: str
    part: str
    pattern: str
    test: str
    base: bool


_KEY = r"(?i:password|passwd|secret|token|api_?key)"
_NAME = r"(?i:user(?:name)?|login|account|client_?id|key_?id)"
_IS = r"[\"']?\x20*[:=]\x20*[\"']?"

KINDS = (
    Kind("assign", "secret", f"{_KEY}{_IS}[A-Za-z0-9+/_.=-]+", rf"(?s)^{_KEY}{_IS}[A-Za-z0-9+/_.=-]{{12,}}$", True),
    Kind("access", "name", r"AKIA[A-Z0-9]+", r"^.{18,}$", True),
    Kind("hex", "secret", r"[0-9a-f]+", r"^.{16,}$", True),
    Kind("name", "name", rf"\b{_NAME}{_IS}[A-Za-z0-9_.@-]{{3,}}", "", False),
    Kind("random", "secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}",
         r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", False),
    Kind("endpoint", "endpoint", r"\b[a-z][a-z0-9+.-]{1,11}://[^\x00-\x20\"'<>]+", "", False),
)
#: Hex runs of the length that passes; shorter runs are matches that are dropped anyway.
_FAST = {"hex": r"[0-9a-f]{16,}"}


def _matches(text: Column, kinds) -> list[Column]:
    return [F.regexp_extract_all(text, F.lit(_FAST.get(k.name, k.pattern)), F.lit(0)).alias(f"m{i}")
            for i, k in enumerate(kinds)]


def _piece(i: int, kind: Kind):
    """(kind, place, length of the text before, of the match, passes?) of a piece."""
    def one(x, at):
        ok = x["m"].isNotNull()
        if kind.test:
            ok = ok & x["m"].rlike(kind.test)
        return F.struct(F.lit(i).alias("kind"), at.alias("i"),
                        F.char_length(x["gap"]).cast("bigint").alias("gap"),
                        F.coalesce(F.char_length(x["m"]), F.lit(0)).cast("bigint").alias("len"),
                        F.coalesce(ok, F.lit(False)).alias("ok"))
    return one


def matches(docs: DataFrame, kinds=KINDS) -> DataFrame:
    """(rid, doc_id, tie, kind, start, end): every match that passes its test,
    and a row with null kind for each document (kind: place in ``kinds``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text")) \
        .select("rid", "doc_id", "text", *_matches(F.col("text"), kinds))
    parts = []
    for i, k in enumerate(kinds):
        m, gaps = F.col(f"m{i}"), F.split("text", _FAST.get(k.name, k.pattern), -1)
        parts.append(F.when(F.size(m) > 0, F.arrays_zip(m.alias("m"), gaps.alias("gap"))).alias(f"p{i}"))
    rows = found.select("rid", "doc_id", F.xxhash64("text").alias("tie"), *parts)
    shape = "array<struct<kind:int,i:int,gap:bigint,len:bigint,ok:boolean>>"
    lists = [F.coalesce(F.transform(f"p{i}", _piece(i, k)), F.array()).cast(shape) for i, k in enumerate(kinds)]
    mark = F.array(F.struct(F.lit(None), F.lit(0), F.lit(0), F.lit(0), F.lit(True))).cast(shape)
    rows = rows.select("rid", "doc_id", "tie", F.explode(F.concat(mark, *lists)).alias("x")).select(
        "rid", "doc_id", "tie", "x.*").repartition("rid")
    run = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run))
    return rows.where("ok").select("rid", "doc_id", "tie", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def linked(spans: DataFrame, kinds=KINDS, scope: int = SCOPE) -> DataFrame:
    """Base matches, and the weak ones whose complementary parts lie within
    ``scope`` characters, apart from them, and that overlap no base match.

    A document's starts and ends are passed over in order of position, ends first: at
    a start, the last end of a part is that of the nearest one that lies wholly before;
    at an end, the next start is that of the nearest one wholly after."""
    part = F.element_at(F.array(*[F.lit(k.part) for k in kinds]), F.col("kind") + 1)
    base = F.element_at(F.array(*[F.lit(k.base) for k in kinds]), F.col("kind") + 1)
    rows = spans.withColumn("part", part).withColumn("base", base)
    order = Window.partitionBy("rid").orderBy("start", "kind", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)

    def near(which: Column, reach: int) -> Column:
        left = F.max(F.when(which, F.col("end"))).over(before)
        right = F.min(F.when(which, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - left <= reach, F.lit(False)) | \
            F.coalesce(right - F.col("end") <= reach, F.lit(False))

    rows = rows.withColumn("covered", near(F.col("base"), -1))
    edges = rows.withColumn("at_end", F.explode(F.array(F.lit(True), F.lit(False)))) \
        .withColumn("place", F.when(F.col("at_end"), F.col("end")).otherwise(F.col("start")))
    passed = Window.partitionBy("rid").orderBy("place", F.desc("at_end"), "start", "kind", "end")
    past = passed.rowsBetween(Window.unboundedPreceding, -1)
    ahead = passed.rowsBetween(1, Window.unboundedFollowing)

    def within(which: str) -> Column:
        mine = F.col("part") == which
        gap = F.when(F.col("at_end"), F.min(F.when(mine & ~F.col("at_end"), F.col("place"))).over(ahead) - F.col("place")) \
            .otherwise(F.col("place") - F.max(F.when(mine & F.col("at_end"), F.col("place"))).over(past))
        return F.coalesce(gap <= scope, F.lit(False))

    edges = edges.withColumn("by_name", within("name")).withColumn("by_secret", within("secret"))
    keys = ["rid", "doc_id", "tie", "kind", "start", "end", "part", "base", "covered"]
    rows = edges.groupBy(*keys).agg(F.bool_or("by_name").alias("by_name"), F.bool_or("by_secret").alias("by_secret"))
    complete = (F.when(F.col("part") == "name", F.col("by_secret"))
                .when(F.col("part") == "secret", F.col("by_name"))
                .otherwise(F.col("by_name") & F.col("by_secret")))
    return rows.where(F.col("kind").isNull() | F.col("base") | (complete & ~F.col("covered"))) \
        .drop("part", "covered", "by_name", "by_secret")


def secret_spans(docs: DataFrame, kinds=KINDS, scope: int = SCOPE) -> DataFrame:
    """Per document: doc_id, tie (hash of the text) and spans, an array of
    (start, kind, end, name, base) in order of start, then of kind."""
    rows = linked(matches(docs.select("doc_id", "text"), kinds), kinds, scope)
    name = F.element_at(F.array(*[F.lit(k.name) for k in kinds]), F.col("kind") + 1)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end", name.alias("name"), "base"))
    return rows.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("tie").alias("tie"),
                                   F.array_sort(F.collect_list(span)).alias("spans")).drop("rid")


def _named(name: str):
    return lambda s: s["name"] == name


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"),
                                                                      s["end"].cast("string"))))


def secret_digest(spans: DataFrame, kinds=KINDS) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans written out."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _named(k.name))).cast("bigint").alias(f"n_{k.name}") for k in kinds]
    return spans.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"),
                        _written(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced (overlapping spans by one mask).

    The text between masks is cut out once per span, in order."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mask)))).otherwise(acc["out"]).alias("out"))

    def finish(acc):
        tail = F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))
        return F.concat(F.array_join(acc["out"], ""), tail)

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
