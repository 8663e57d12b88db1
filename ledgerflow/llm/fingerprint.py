"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its terms are its lower-cased words, the weight of a term is the number
of characters that it covers.  Sample i of a weighted set draws for each term, from a hash of term
and i alone, r and c from Gamma(2, 1) and b from [0, 1); with t = floor(ln w / r + b) the term
bids ln a = ln c - r (t - b + 1), and the lowest bid's (term, t) is the sample.  Two texts agree on
a sample with probability sum(min(w, w')) / sum(max(w, w')), their generalised Jaccard similarity,
so the share of equal samples estimates it.  A fingerprint is ``SAMPLES`` samples of 16 bits.

Gamma(2, 1) is read from a table of ``TABLE`` quantiles by bits of the hash, so a bid costs one hash
and no logarithm but that of the weight.  The bids are ordinary columns, ``PER_ROW`` samples a row
to keep the compiled methods small, and the lowest is a ``min`` over bids packed with their sample
bits.  Texts are shuffled once, by id; terms, bids and minima stay in that partitioning.  Only
DataFrame functions run.

Defined results: a null text is empty; a text without words has the constant fingerprint of an
empty set, equal to that of every other such text; a null id sorts first; of rows with one id the
smallest text stands for it as the next document; equal rows give equal rows, and of many rows with
one id each different text is worked on once, by id and text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import with_sequence_id
from .common import cut

SAMPLES = 64
PER_ROW = 4
TABLE = 2048
RUN = 1024
NULL_KEY = -(1 << 63)


def gamma_quantiles(n: int) -> list[float]:
    """The quantiles (i + 1/2) / n of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x)."""
    out = []
    for i in range(n):
        q, lo, hi = (i + 0.5) / n, 0.0, 60.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 1 - (1 + mid) * math.exp(-mid) < q else (lo, mid)
        out.append((lo + hi) / 2)
    return out


def _table(values: list[float]) -> Column:
    return F.expr(f"array({','.join(f'{v!r}D' for v in values)})")


def signatures(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: for each text column its samples as array<smallint>.

    ``texts`` should be partitioned by (some of) the keys already; then nothing here shuffles.
    """
    tagged = texts.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("text")) for i, c in enumerate(columns)])).alias("_t"))
    word = tagged.select(*keys, F.col("_t.which").alias("_which"), F.explode_outer(F.split(F.lower("_t.text"), r"\s+")).alias("_word"))
    weight = F.char_length("_word")  # 0 for the empty words around leading and trailing space
    terms = (word.select(*keys, "_which", F.xxhash64("_word").alias("_term"), weight.alias("_len"))
             .groupBy(*keys, "_term").agg(*[F.sum(F.when(F.col("_which") == i, F.col("_len"))).alias(f"_w{i}") for i in range(len(columns))]))
    logs = {f"_w{i}": F.when(F.col(f"_w{i}") > 0, F.ln(F.col(f"_w{i}").cast("double"))) for i in range(len(columns))}
    rows = terms.withColumns(logs).withColumn("_g", F.explode(F.array(*[F.lit(g) for g in range(SAMPLES // PER_ROW)])))
    quantiles = gamma_quantiles(TABLE)
    gamma, log_gamma = _table(quantiles), _table([math.log(q) for q in quantiles])
    rows = rows.withColumns({f"_h{j}": F.xxhash64("_term", F.col("_g") * PER_ROW + j) for j in range(PER_ROW)})
    bits = lambda j, shift, mask: F.shiftrightunsigned(f"_h{j}", shift).bitwiseAND(F.lit(mask))
    rows = rows.withColumns({f"_r{j}": F.get(gamma, F.col(f"_h{j}").bitwiseAND(F.lit(TABLE - 1)).cast("int")) for j in range(PER_ROW)}
                            | {f"_c{j}": F.get(log_gamma, bits(j, 11, TABLE - 1).cast("int")) for j in range(PER_ROW)}
                            | {f"_b{j}": bits(j, 22, (1 << 26) - 1) / F.lit(float(1 << 26)) for j in range(PER_ROW)})
    steps = {f"_t{i}_{j}": F.floor(F.col(f"_w{i}") / F.col(f"_r{j}") + F.col(f"_b{j}")) for i in range(len(columns)) for j in range(PER_ROW)}
    rows = rows.withColumns(steps)
    bids = {}
    for i in range(len(columns)):
        for j in range(PER_ROW):
            t = F.col(f"_t{i}_{j}")
            bid = F.col(f"_c{j}") - F.col(f"_r{j}") * (t - F.col(f"_b{j}") + 1.0)
            sample = bits(j, 48, 0xFFFF).bitwiseXOR(t).bitwiseAND(F.lit(0xFFFF))
            bids[f"_m{i}_{j}"] = F.shiftleft(((bid + 64.0) * float(1 << 36)).cast("long"), 16).bitwiseOR(sample)
    rows = rows.select(*keys, "_g", *[c.alias(n) for n, c in bids.items()])
    least = rows.groupBy(*keys, "_g").agg(*[F.min(n).alias(n) for n in bids])
    part = lambda i: F.array(*[F.coalesce(F.col(f"_m{i}_{j}").bitwiseAND(F.lit(0xFFFF)) - 0x8000, F.lit(-1)).cast("smallint") for j in range(PER_ROW)])
    whole = least.select(*keys, F.struct("_g", *[part(i).alias(f"p{i}") for i in range(len(columns))]).alias("_part")).groupBy(*keys).agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    return whole.select(*keys, *[F.flatten(F.col(f"_parts.p{i}")).alias(c) for i, c in enumerate(columns)])


def likeness(a: str, b: str) -> Column:
    """The share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(SAMPLES))


def as_text(samples: str) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex((x.cast("int") + 0x8000).cast("long"))), 4, "0")), "")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("_k"), F.coalesce("text", F.lit("")).alias("_text"))
    ids = own.groupBy("_k").agg(F.max(F.char_length("_text")).alias("_n"), F.count("*").alias("_rows"))
    order = with_sequence_id(ids, ["_k"], "_at", start=0)
    facts = order.agg(F.count("*").alias("n"), F.max("_rows").alias("rows")).first()
    n = max(1, facts["n"])
    before = order.select(F.col("_k").alias("_next"), ((F.col("_at") + (n - 1)) % n).alias("_at"))
    follows = cut(order.select("_k", "_n", "_at").join(before, "_at").select("_k", "_next", F.floor(F.col("_n") / 4).cast("int").alias("_need")))
    repeated = (facts["rows"] or 0) > 1
    if repeated:  # each text of an id once, with its copies; else the copies' weights would add up
        own = own.groupBy("_k", F.xxhash64("_text").alias("_same")).agg(F.min("_text").alias("_text"), F.count("*").alias("_copies"))
    heads = (own.join(follows.select(F.col("_k").alias("_prev"), F.col("_next").alias("_k"), "_need"), "_k")
             .select(F.col("_prev").alias("_k"), F.expr("left(_text, _need)").alias("_head")))
    if repeated:  # the head of the smallest text is the smallest head
        heads = heads.groupBy("_k").agg(F.min("_head").alias("_head"))
    chars = F.char_length("_text")
    edited = F.concat(F.expr("left(_text, char_length(_text) - floor(char_length(_text) / 4)::int)"), F.expr("left(_head, floor(char_length(_text) / 4)::int)"))
    both = own.join(heads, "_k").select("_k", "_text", edited.alias("_edited"), *(["_copies"] if repeated else [])).withColumn("_same", F.xxhash64("_text"))
    if repeated:  # the texts of one id are spread as well
        both = both.repartition("_k", "_same")
    base = both.select("_k", "_same", *(["_copies"] if repeated else []), chars.cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"))
    # nothing but _k is a shuffle key so far: terms and samples of a text are gathered where the text already is
    signs = signatures(both, ["_k", "_same"], ["_text", "_edited"])
    table = cut(base.join(signs, ["_k", "_same"]).join(follows.select("_k", "_next"), "_k")
                .select("_k", "_next", *(["_copies"] if repeated else []), "n_chars", "edited_sha256", F.col("_text").alias("_own"), F.col("_edited").alias("_other")))
    following = table.select(F.col("_k").alias("_next"), F.col("_own").alias("_following"))
    if repeated:
        following = following.groupBy("_next").agg(F.min("_following").alias("_following"))
        # a row for each copy again, dealt out in runs
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / RUN)))
        dealt = table.withColumn("_run", runs).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        table = dealt.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN), F.col("_copies") - F.col("_run") * RUN))))
    return (table.join(following, "_next")
            .select(F.when(F.col("_k") != NULL_KEY, F.col("_k")).alias("doc_id"), "n_chars", "edited_sha256", as_text("_own").alias("fingerprint"),
                    as_text("_other").alias("edited_fingerprint"), likeness("_own", "_other").alias("near_edited"),
                    likeness("_own", "_following").alias("near_next")))
