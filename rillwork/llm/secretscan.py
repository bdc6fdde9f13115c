"""Secret scans with multipart linking, in DataFrame functions only.

Base spans: three patterns, leftmost and not overlapping within a kind. Weak parts: words that may be one part of a credential, an access
identifier (`ident`), a secret (`secret`) or an endpoint (`endpoint`). Within a document, weak parts are interval-joined with what complements them: two
parts meet if at most SCOPE characters lie between them. A weak identifier counts if a secret is near, a weak secret if an identifier or an endpoint is near, and an endpoint if
both are. Base `access` spans serve as identifiers and `assign` and `hex` spans as secrets. The join is two running extremes over the
parts in order (the furthest end so far, the nearest start still to come), so it is linear, however many parts lie close together.

Each part that counts comes with its partners, as links: of the complementary parts within the scope, the one before that ends last, else the one after that starts first.

Positions count code points from 0, ends are exclusive. Null texts count as empty: no spans, empty strings of spans. Rows that repeat an id are scanned each on its own.
Texts are read whole; spans are numbered in blocks, so that very many in one text cost no more each. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE, SPAN_BLOCK = 200, 256
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
IDENT = r"""(?i:(?:access_?key_?id|client_?id|user(?:name)?|login|account|key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
SECRET = r"""[A-Za-z0-9+/]{20,}={0,2}"""  # with a digit, an upper and a lower case letter
ENDPOINT = r"""(?:[a-z][a-z0-9+]{1,9}://[A-Za-z0-9._-]+(?::[0-9]+)?|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,})"""
#: kind, pattern, what its text must hold (a cheap test before the pattern), rank among spans that start together
BASE = (("assign", ASSIGN, r"(?i)(?:passw|secret|token|api_?key)"), ("access", r"AKIA[A-Z0-9]{12,}", "AKIA"), ("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32}"))
WEAK = (("ident", IDENT, r"(?i)(?:id|user|username|login|account)[\"']?\x20*[:=]"), ("secret", SECRET, r"[A-Za-z0-9+/]{20}"), ("endpoint", ENDPOINT, r"://|(?i)(?:host|endpoint|server)[\"']?\x20*[:=]"))
MARK, STAND_IN = "\u0001", "\u0002"
SPAN = "array<struct<start:long,rank:int,stop:long,kind:string>>"


def spans(text: Column, kind: str, pattern: str, test: str, rank: int, good=None) -> Column:
    """Matches in order, as structs; text holds no MARK. Pieces at odd places of the split are matches; their places are running sums, in blocks."""
    pieces = F.split(F.regexp_replace(text, pattern, MARK + "$0" + MARK), MARK)
    n = F.size(pieces)
    starts = F.sequence(F.lit(0), F.floor((n - 1) / SPAN_BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(pieces, b * SPAN_BLOCK + 1, SPAN_BLOCK))
    lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, p: s + F.char_length(p)))
    empty = F.array().cast("array<long>")
    offsets = F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("all")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
    none = F.array().cast(SPAN)

    def place(block: Column, offset: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            stop = s["at"] + F.char_length(p)
            fine = s["odd"] if good is None else s["odd"] & good(p)
            got = F.array(F.struct(s["at"].alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind")))
            return F.struct(stop.alias("at"), (~s["odd"]).alias("odd"), F.when(fine, F.concat(s["out"], got)).otherwise(s["out"]).alias("out"))

        return F.aggregate(block, F.struct(offset.alias("at"), F.lit(False).alias("odd"), none.alias("out")), step)["out"]

    return F.when(text.rlike(test), F.flatten(F.zip_with(blocks, offsets, place))).otherwise(none)


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, links (span>partner+partner, joined by commas)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, STAND_IN).alias("text"))
    good = {"assign": lambda p: F.char_length(F.regexp_extract(p, ASSIGN, 2)) >= 8, "secret": lambda p: p.rlike("[0-9]") & p.rlike("[A-Z]") & p.rlike("[a-z]")}
    cols = [spans(F.col("text"), k, p, t, r, good.get(k)).alias(k) for r, (k, p, t) in enumerate(BASE)]
    weak = [spans(F.col("text"), k, p, t, 3 + r, good.get(k)).alias("weak_" + k) for r, (k, p, t) in enumerate(WEAK)]
    found = d.select("doc_id", F.monotonically_increasing_id().alias("row_id"), *cols, *weak)
    base = F.array_sort(F.concat("assign", "access", "hex"))
    counted = found.select(
        "doc_id",
        "row_id",
        *[F.size(k).cast("long").alias("n_" + k) for k, _, _ in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        F.array_sort(F.concat("assign", "access", "hex", *["weak_" + k for k, _, _ in WEAK])).alias("parts"),
    )
    parts = counted.select("*", F.posexplode_outer("parts").alias("place", "p")).drop("parts").select("*", "p.start", "p.stop", "p.rank", "p.kind")
    is_id, is_secret, is_end = F.col("kind").isin("access", "ident"), F.col("kind").isin("assign", "hex", "secret"), F.col("kind") == "endpoint"
    row = Window.partitionBy("row_id")
    before = row.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    after = row.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)

    def shown(part: Column) -> Column:
        return F.concat_ws(":", part["kind"], part["start"].cast("string"), part["stop"].cast("string"))

    def near(flag: Column) -> Column:
        """The nearest part with that flag, or null if none is within the scope."""
        back = F.max(F.when(flag, F.struct("stop", "start", "kind"))).over(before)
        ahead = F.min(F.when(flag, F.struct("start", "stop", "kind"))).over(after)
        return F.when(F.col("start") - back["stop"] <= scope, shown(back)).when(ahead["start"] - F.col("stop") <= scope, shown(ahead))

    linked = parts.withColumns({"near_id": near(is_id), "near_secret": near(is_secret), "near_end": near(is_end)})
    met = {k: F.col(k).isNotNull() for k in ("near_id", "near_secret", "near_end")}
    keep = (F.col("rank") < 3) | F.when(F.col("kind") == "ident", met["near_secret"]).when(F.col("kind") == "secret", met["near_id"] | met["near_end"]).when(F.col("kind") == "endpoint", met["near_id"] & met["near_secret"])
    partners = F.when(is_id, F.concat_ws("+", "near_secret")).when(is_secret, F.concat_ws("+", "near_id", "near_end")).otherwise(F.concat_ws("+", "near_id", "near_secret"))
    kept = F.array_sort(F.collect_list(F.when(keep, F.struct("start", "rank", "stop", "kind", partners.alias("partners")))))
    out = linked.groupBy("row_id", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256").agg(kept.alias("all"))
    links = F.transform(F.filter("all", lambda s: s["partners"] != ""), lambda s: F.concat(shown(s), F.lit(">"), s["partners"]))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", joined(F.col("all")).alias("spans"), F.array_join(links, ",").alias("links"))
