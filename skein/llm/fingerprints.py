"""Document fingerprints: a threshold-scaled sketch of word shingles.

DataFrame functions only. A document's sketch holds the 64-bit hashes of its shingles of
five words that lie below a fixed fraction (1 / SCALE) of the hash range, and nothing
else; a text of fewer than five words is one shingle. Sketches of parts merge by union,
and as every sketch keeps the same part of the hash range, the share of one sketch found
in another estimates containment however unequal the documents are.

A short document may have no hash below the threshold. Its lowest hash is kept beside
the sketch, in a column of its own that takes no part in merging or containment: where
neither of two documents has a sketch, equal lowest hashes, which have the probability
of the Jaccard similarity too, stand in for their likeness. Containment is null where a
document with words has no sketch. The printed fingerprint is the sketch or, where it
is empty, the lowest hash, which is known by lying above the threshold.

Each document is also compared with the next by descending id, and with an edited copy
of itself that ends in the next one's beginning. Next documents meet in buckets of
neighbouring ids, cut by rank: quantiles of the ids bound BINS bins, and quantiles
inside every bin its buckets, so clustered ids don't fill one. An id that fills several
buckets, and null ids, are dealt out by a hash of their texts. The highest document of a
bucket is copied to the next bucket above. Texts are shuffled once, without sketches,
which are made where documents have met.

Results for special inputs: a null text counts as empty. Null ids come last in
descending order. Rows that repeat an id follow each other by the hash of their texts,
highest first. The only row of a table is its own next. Two texts without words have
likeness 1, one with and one without have 0. An empty table gives an empty table. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import checkpointed, id_and_text

WORDS, SCALE = 5, 8
WORD = r"[^\x20\x09-\x0D]+"
#: Signed hashes below this are the lowest 1 / SCALE of the range.
BELOW = -(1 << 63) + (1 << 64) // SCALE
#: Bins of the ids; documents in a bucket, unless that made more than BIN_BUCKETS in a bin, which bounds
#: the broadcast tables: BINS rows of BIN_BUCKETS ids, and BINS * BIN_BUCKETS rows of bucket numbers.
BINS, BUCKET_ROWS, BIN_BUCKETS = 256, 128, 512


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with columns out, the sorted sketch of its text column, and out_lowest, the lowest hash of all."""
    words, hashes = f"{out}_words", f"{out}_hashes"
    w = F.col(words)
    shingles = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
    every = F.when(F.size(w) >= WORDS, shingles).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    h = F.col(hashes)
    rows = df.withColumn(words, F.regexp_extract_all(F.col(text), F.lit(WORD), 0)).withColumn(hashes, every)
    return rows.withColumns({out: F.array_sort(F.array_distinct(F.filter(h, lambda x: x < BELOW))), f"{out}_lowest": F.array_min(h)}).drop(words, hashes)


def likeness(a: Column, b: Column, lowest_a: Column, lowest_b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches' documents."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(F.size(a) + F.size(b) == 0, lowest_a.eqNullSafe(lowest_b).cast("double")).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column, lowest_a: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for a text without words, null for one without a sketch."""
    return F.when(lowest_a.isNull(), 1.0).when(F.size(a) > 0, F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def merged(sketches: Column) -> Column:
    """The sketch of parts (an array of their sketches) together."""
    return F.array_sort(F.array_distinct(F.flatten(sketches)))


def sketch_string(sketch: Column, lowest: Column) -> Column:
    """Hashes in ascending order, 16 hex digits each; of an empty sketch, the lowest hash of all."""
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.lower(F.when(F.size(sketch) > 0, F.array_join(F.transform(sketch, digits), "")).otherwise(F.coalesce(digits(lowest), F.lit(""))))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sketch (array<bigint>), lowest (the lowest hash of all) of every whole text."""
    return with_sketch(id_and_text(df, id_col, text_col), "text", "sketch").select("doc_id", "sketch", F.col("sketch_lowest").alias("lowest"))


def _at_most(edges: Column, x: Column, strictly: bool = False) -> Column:
    """How many of the ascending edges are at most (or below) x, by halving."""
    n = F.size(edges)
    steps = F.sequence(F.length(F.bin(n.cast("long"))) - 1, F.lit(0))

    def step(at: Column, k: Column) -> Column:
        further = at + F.call_function("shiftleft", F.lit(1), k)
        edge = F.get(edges, further - 1)  # null, hence no step, beyond the end
        return F.when(edge < x if strictly else edge <= x, further).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _share(h: Column) -> Column:
    """A hash's place in its range, from 0 to 1."""
    return h.cast("double") / float(1 << 64) + 0.5


def with_bucket(docs: DataFrame) -> DataFrame:
    """docs (doc_id, tie: a hash of the row) with a bucket number that ascends with (doc_id, tie), null ids lowest, cut by rank."""
    got = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("with_id"), F.percentile_approx("doc_id", [k / BINS for k in range(1, BINS)], 20_000).alias("q")).head()
    per_bin = min(BIN_BUCKETS, max(1, -(-got["with_id"] // (BUCKET_ROWS * BINS))))
    nulls = min(BINS * BIN_BUCKETS, max(1, -(-(got["n"] - got["with_id"]) // BUCKET_ROWS)))
    x, tie = F.col("doc_id"), F.col("tie")

    def binned(rows: DataFrame, edges: Column, out: str) -> DataFrame:
        """The bin of an id; an id that is several edges takes their bins by its share of the hash range, and goes on with its share of that bin."""
        rows = rows.withColumns({"__below": _at_most(edges, x, strictly=True), "__upto": _at_most(edges, x)})
        many = F.col("__upto") - F.col("__below")
        at = F.least(many - 1, F.floor(F.col("__share") * many).cast("int"))
        rows = rows.withColumn(out, F.when(many > 1, F.col("__below") + 1 + at).otherwise(F.col("__upto")))
        return rows.withColumn("__share", F.when(many > 1, F.col("__share") * many - at).otherwise(F.col("__share"))).drop("__below", "__upto")

    first = F.array(*[F.lit(e).cast("long") for e in got["q"] or [0]])
    rows = binned(docs.withColumn("__share", _share(tie)), first, "__bin")
    if per_bin > 1:
        narrow = binned(docs.select("doc_id", _share(tie).alias("__share")).filter(x.isNotNull()), first, "__bin")
        second = narrow.groupBy("__bin").agg(F.percentile_approx("doc_id", [k / per_bin for k in range(1, per_bin)], 20_000).alias("__edges"))
        second = F.broadcast(checkpointed(second.select(F.col("__bin").alias("__of"), "__edges")))  # at most BINS rows
        rows = binned(rows.join(second, F.col("__bin") == F.col("__of"), "left"), F.coalesce("__edges", F.array().cast("array<bigint>")), "__part").drop("__of", "__edges")
    else:
        rows = rows.withColumn("__part", F.lit(0))
    number = F.col("__bin").cast("long") * BIN_BUCKETS + F.col("__part") + 1
    null = -1 - F.least(F.lit(nulls - 1), F.floor((1 - _share(tie)) * nulls)).cast("long")
    return rows.withColumn("bucket", F.when(x.isNull(), null).otherwise(number)).drop("__bin", "__part", "__share")


def met(docs: DataFrame) -> DataFrame:
    """docs (doc_id, tie and others) by bucket b, with the highest row of each bucket also, as copy, in the next one above.

    The table's last row by descending order is followed by its first, which is copied to
    the lowest bucket.
    """
    rows = with_bucket(docs)
    top = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id"), F.col("tie"))).alias("top")
    heads = rows.select("bucket", "doc_id", "tie").groupBy("bucket").agg(top)
    # At most BINS * BIN_BUCKETS rows with an id and as many without, of a few numbers.
    above, every = Window.orderBy("bucket"), Window.partitionBy()
    heads = checkpointed(heads.select("bucket", "top", F.coalesce(F.lead("bucket").over(above), F.min("bucket").over(every)).alias("to")))
    heads = F.broadcast(heads.select(F.col("bucket").alias("from"), F.col("top.doc_id").alias("head"), F.col("top.tie").alias("head_tie"), "to"))
    own = rows.join(heads, (F.col("bucket") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")), "left")
    here = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("copy"))
    places = F.when(F.col("to").isNotNull(), F.array(here, F.struct(F.col("to").alias("b"), F.lit(True).alias("copy")))).otherwise(F.array(here))
    dealt = own.select(*docs.columns, F.inline(places))
    return dealt.repartition(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "b")


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows of met() without the copies and, as struct column next, these columns of the next document by descending id."""
    line = Window.partitionBy("b").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return rows.withColumn("next", F.lead(F.struct(*columns)).over(line)).filter(~F.col("copy")).drop("b", "copy", "tie")


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and both containments."""
    docs = id_and_text(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    rows = with_next(with_sketch(met(docs), "text", "sketch"), ["text", "sketch", "sketch_lowest"])
    n, half = F.length("text"), F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "sketch_lowest", F.col("next.sketch").alias("after"), F.col("next.sketch_lowest").alias("after_lowest"), edited.alias("edited"))
    rows = with_sketch(rows, "edited", "new")
    own, low = F.col("sketch"), F.col("sketch_lowest")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch_string(own, low).alias("fingerprint"),
        sketch_string(F.col("new"), F.col("new_lowest")).alias("edited_fingerprint"),
        likeness(own, F.col("new"), low, F.col("new_lowest")).alias("near_edited"),
        likeness(own, F.col("after"), low, F.col("after_lowest")).alias("near_next"),
        containment(own, F.col("new"), low).alias("contained_in_edited"),
        containment(own, F.col("after"), low).alias("contained_in_next"),
    )
