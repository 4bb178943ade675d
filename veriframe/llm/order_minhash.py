"""Order MinHash fingerprints (DataFrame functions only).

A text is a sequence of tokens: runs of up to 12 characters between blanks, an ideograph
or syllable sign alone. Its k-mers of two tokens are numbered by occurrence, so a repeated
k-mer counts as often as it stands there. For each of ``SLOTS`` orders the ``TUPLE`` smallest
numbered k-mers are selected, put back in text order and hashed together; a moved or
edited passage changes the tuples, so equal slots estimate closeness in edit distance.

The orders are rotations of one 64-bit hash ring: the smallest k-mers of slot i are those
that follow the point i / SLOTS of the ring. One sort serves all slots.

Defined results: a null text is the empty text; a text without tokens has a fingerprint of
zeros; one shorter than k tokens has its whole token sequence as its only k-mer. Likeness
is the share of equal slots, so two empty texts are alike with 1.0. Equal texts, repeated
rows too, have equal fingerprints. Other columns are kept; clashing names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 64
TUPLE = 2
K = 2
#: Low bits of a sort word that hold a position; the rest is the hash.
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1
DIGITS = 4
TOKENS = r"[⺀-鿿가-힯]|[^\x20\x09-\x0D⺀-鿿가-힯]{1,12}"
EMPTY = "0" * (SLOTS * DIGITS)
#: Documents per bucket of the ordered pass, about.
BUCKET_ROWS = 400
MAX_BUCKETS = 20_000


def _packed(h: Column, i: Column) -> Column:
    return h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint of ``text`` as a string of ``SLOTS`` groups of hex digits."""
    kept = [c for c in df.columns if c != out]
    df = df.select(*kept, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKENS), 0).alias("_t"))
    df = df.select(*kept, F.transform("_t", lambda w: F.xxhash64(w)).alias("_t"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("_t") - K),
        lambda i: _packed(F.xxhash64(*[F.get(F.col("_t"), i + d) for d in range(K)]), i),
    )
    whole = F.transform("_t", lambda h, i: _packed(h, i))
    df = df.select(*kept, F.sort_array(F.when(F.size("_t") >= K, pairs).otherwise(whole)).alias("_s"))
    # Equal k-mers are neighbours, in text order; their place in the run is the occurrence number.
    same = F.size("_s") > F.size(F.array_distinct(F.transform("_s", lambda x: F.shiftright(x, PLACE_BITS))))
    first = F.filter(
        F.transform("_s", lambda x, j: F.when(F.coalesce(F.shiftright(F.get(F.col("_s"), j - 1), PLACE_BITS) != F.shiftright(x, PLACE_BITS), F.lit(True)), j)),
        lambda j: j.isNotNull(),
    )
    df = df.select(*kept, "_s", F.when(same, first).alias("_f"))
    runs = F.flatten(F.transform("_f", lambda st, q: F.sequence(F.lit(0), F.coalesce(F.get(F.col("_f"), q + 1), F.size("_s")) - st - 1)))
    df = df.select(*kept, "_s", F.when(F.col("_f").isNotNull(), runs).alias("_o"))
    def number(x, o):
        return _packed(F.xxhash64(F.shiftright(x, PLACE_BITS), o), x.bitwiseAND(F.lit(PLACE)))

    numbered = F.when(F.col("_o").isNotNull(), F.zip_with("_s", "_o", number)).otherwise(F.transform("_s", lambda x: number(x, F.lit(0))))
    df = df.select(*kept, F.sort_array(numbered).alias("_r"))
    n = F.size("_r")
    depth = 31

    def follows(point: Column) -> Column:
        """Index of the first sort word at or after a point of the ring, by bisection."""
        ends = F.struct(F.lit(0).alias("a"), n.alias("b"))

        def halve(e, _):
            mid = F.shiftright(e["a"] + e["b"], 1)
            below = F.get(F.col("_r"), mid) < point
            return F.when(e["a"] >= e["b"], e).when(below, F.struct((mid + 1).alias("a"), e["b"].alias("b"))).otherwise(F.struct(e["a"].alias("a"), mid.alias("b")))

        steps = F.sequence(F.lit(0), F.least(F.ceil(F.log2(n + 1)).cast("int"), F.lit(depth)))
        return F.aggregate(steps, ends, halve, lambda e: e["a"])

    def slot(point: Column) -> Column:
        at = follows(point)
        picked = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(TUPLE)) - 1), lambda d: F.get(F.col("_r"), F.pmod(at + d, n)))
        ordered = F.array_sort(F.transform(picked, lambda x: F.struct(x.bitwiseAND(F.lit(PLACE)).alias("i"), F.shiftright(x, PLACE_BITS).alias("h"))))
        return F.right(F.lpad(F.hex(F.xxhash64(F.transform(ordered, lambda x: x["h"]))), 16, "0"), F.lit(DIGITS))

    points = F.array(*[F.lit(-(1 << 63) + i * ((1 << 64) // SLOTS)) for i in range(SLOTS)])
    digest = F.lower(F.array_join(F.transform(points, slot), ""))
    return df.select(*kept, F.when(n > 0, digest).otherwise(F.lit(EMPTY)).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots of two fingerprints."""
    same = F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.substring(a, i * DIGITS + 1, DIGITS) == F.substring(b, i * DIGITS + 1, DIGITS))
    return (F.size(same) / F.lit(float(SLOTS))).cast("double")


def _bucket(key: Column, edges: list[int]) -> Column:
    """Number of edges at or under the key, by bisection; nulls go to bucket 0."""
    if not edges:
        return F.lit(0)
    points = F.array(*[F.lit(e).cast("long") for e in edges])
    ends = F.struct(F.lit(0).alias("a"), F.lit(len(edges)).alias("b"))

    def halve(e, _):
        mid = F.shiftright(e["a"] + e["b"], 1)
        above = F.get(points, mid) <= key
        return F.when(e["a"] >= e["b"], e).when(above, F.struct((mid + 1).alias("a"), e["b"].alias("b"))).otherwise(F.struct(e["a"].alias("a"), mid.alias("b")))

    steps = F.sequence(F.lit(0), F.lit(len(edges).bit_length()))
    return F.when(key.isNull(), F.lit(0)).otherwise(F.aggregate(steps, ends, halve, lambda e: e["a"]))


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the row that follows in ascending ``key`` (after the last: the first).

    Ties are ordered by ``columns``; a null key comes first. Rows are dealt to buckets of
    neighbouring keys; the first key of each bucket is also sent to the one before it, so that
    no window spans more than a bucket and the rows move once."""
    ids = df.select(F.col(key).alias("_k"))
    rows = ids.count()
    parts = max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))
    edges = []
    if parts > 1:
        row = ids.agg(F.percentile_approx("_k", [i / parts for i in range(1, parts)], 10 * parts).alias("e")).first()
        edges = sorted(set(row["e"] or []))
    bucket = _bucket(F.col("_k"), edges)
    # Bounded by the number of buckets: the least key of each that has rows.
    starts = ids.select("_k", bucket.alias("_b")).groupBy("_b").agg(F.min("_k").alias("k"), F.max(F.col("_k").isNull()).alias("null")).orderBy("_b").collect()
    first = {(None if r["null"] else r["k"]): starts[i - 1]["_b"] for i, r in enumerate(starts)}
    null_before = first.pop(None, None)
    before = F.lit(None).cast("int")
    if first:
        listed = sorted(first)
        at = _bucket(F.col(key), listed) - 1
        keys, befores = F.array(*[F.lit(k).cast("long") for k in listed]), F.array(*[F.lit(first[k]) for k in listed])
        before = F.when((at >= 0) & (F.get(keys, at) == F.col(key)), F.get(befores, at))
    if null_before is not None:
        before = F.when(F.col(key).isNull(), F.lit(null_before)).otherwise(before)
    own = F.struct(_bucket(F.col(key), edges).alias("b"), F.lit(0).alias("ghost"))
    ghost = F.struct(before.alias("b"), F.lit(1).alias("ghost"))
    dealt = df.select("*", F.explode(F.when(before.isNotNull(), F.array(own, ghost)).otherwise(F.array(own))).alias("_at"))
    order = Window.partitionBy("_at.b").orderBy("_at.ghost", F.col(key).asc_nulls_first(), *columns)
    out = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return out.where(F.col("_at.ghost") == 0).drop("_at")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike neighbours are."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = with_next(with_fingerprint(df, "text", "fingerprint"), "doc_id", ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = df.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
                   F.concat(F.left("text", n - half), F.left("next_text", half)).alias("_edited"))
    df = with_fingerprint(df, "_edited", "edited_fingerprint")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
