"""Nearest history text of each row by its words: the mean of Jaccard and TF cosine, exactly.

Texts of the same words are compared once. Rows meet the history through its rare words first, whose lists are short on one side. What a
row's frequent words alone could reach is bounded; only rows whose bound is not below what they have found meet the whole history, block by
block, where tasks count shared words in arrays. So no frequent word is ever the key of a join, and pairs are written only for rare words.

``next_cosine`` compares each text with the next: texts are shuffled once, to blocks of ids, and a block's different words once, not once for each of its texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnowry.sources.tables import cut

#: A word is rare if at most so many history texts have it.
RARE = 64
#: Rows and history texts that a task compares.
ROWS, TEXTS = 1024, 8192
#: Lanes over which the rows of one text are dealt when they get its result.
LANES = 16
OUT = "key string, sim double, other long"
#: Ids of a block of texts that are compared with the next one.
IDS = 1024
#: A block: its ids; where each one's words begin; words by number, and how often; the words, and how many of the block's own texts have each.
BLOCK = "block long, ids array<long>, starts array<int>, of array<int>, n array<int>, words array<string>, own array<int>"


def rounded(x: Column) -> Column:
    """To nine places, as the tasks do."""
    return F.floor(x * 1e9 + 0.5) / 1e9


def bags(df: DataFrame) -> DataFrame:
    """(key, id, words): the different texts of (id, tokens), each with its least id and its words' counts."""
    keyed = df.where(F.size("tokens") > 0).select("id", F.array_join(F.array_sort("tokens"), " ").alias("key"))
    once = keyed.groupBy("key").agg(F.min("id").alias("id"))
    counted = once.select("key", "id", F.explode(F.split("key", " ")).alias("w")).groupBy("key", "id", "w").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.groupBy("key", "id").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("words"))


def _norm(words: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(words), F.lit(0).cast("long"), lambda s, n: s + n * n).cast("double"))


def _sim(a: Column, b: Column) -> Column:
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    dot = F.aggregate(both, F.lit(0).cast("long"), lambda s, w: s + a[w] * b[w])
    return rounded((F.size(both) / (F.size(a) + F.size(b) - F.size(both)) + dot / (_norm(a) * _norm(b))) / 2)


def _in_blocks(key, rows: pa.Table, history: pa.Table) -> pa.Table:
    import numpy as np

    empty = pa.table({"key": pa.array([], pa.string()), "sim": pa.array([], pa.float64()), "other": pa.array([], pa.int64())})
    if not rows.num_rows or not history.num_rows:
        return empty

    def flat(t):
        words = t.column("words").combine_chunks()
        sizes = np.diff(words.offsets.to_numpy())
        return words.keys, words.items.to_numpy().astype(np.int64), np.repeat(np.arange(t.num_rows), sizes), sizes

    history = history.sort_by("id")
    (a_words, a_n, a_of, a_sizes), (b_words, b_n, b_of, b_sizes) = flat(rows), flat(history)
    words = pa.concat_arrays([a_words, b_words]).dictionary_encode().indices.to_numpy()
    a_word, b_word = words[: len(a_n)], words[len(a_n) :]
    by = np.argsort(b_word, kind="stable")
    starts, ends = np.searchsorted(b_word[by], a_word), np.searchsorted(b_word[by], a_word, "right")
    norms_a, norms_b = np.sqrt(np.bincount(a_of, a_n * a_n)), np.sqrt(np.bincount(b_of, b_n * b_n))
    first = np.concatenate([[0], np.cumsum(a_sizes)])
    keys, sims, others = [], [], []
    ids, names = history.column("id").to_numpy(), rows.column("key").to_pylist()
    for i in range(rows.num_rows):
        own = range(first[i], first[i + 1])
        hit = np.concatenate([by[starts[j] : ends[j]] for j in own])
        if not len(hit):
            continue
        n = np.concatenate([np.full(ends[j] - starts[j], a_n[j]) for j in own])
        met = b_of[hit]
        shared, dot = np.bincount(met, minlength=history.num_rows), np.bincount(met, n * b_n[hit], history.num_rows)
        sim = np.floor((shared / (a_sizes[i] + b_sizes - shared) + dot / (norms_a[i] * norms_b)) / 2 * 1e9 + 0.5) / 1e9
        best = int(sim.argmax())
        keys.append(names[i])
        sims.append(sim[best])
        others.append(ids[best])
    return pa.table({"key": pa.array(keys, pa.string()), "sim": pa.array(sims, pa.float64()), "other": pa.array(others, pa.int64())})


def lexical_best(rows: DataFrame, history: DataFrame) -> DataFrame:
    """(id, sim, best_id): the most similar history text of each row, to nine places, the least id of ties; rows that share no word with any have none.

    rows, history: (id, tokens); words hold no space.
    """
    a, b = cut(bags(rows.select("id", "tokens")), "bags"), cut(bags(history.select("id", "tokens")), "bags")
    texts = b.select(F.col("id").alias("other"), F.col("words").alias("theirs"))
    lists = texts.select("other", F.explode(F.map_keys("theirs")).alias("w"))
    held = lists.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ours = a.select("key", F.explode("words").alias("w", "n")).join(held, "w")
    rare = lists.join(held.where(F.col("df") <= RARE), "w").select("w", "other")
    pairs = ours.where(F.col("df") <= RARE).select("key", "w").join(rare, "w").select("key", "other").distinct()
    scored = pairs.join(texts, "other").join(a.select("key", "words"), "key").select("key", _sim(F.col("words"), F.col("theirs")).alias("sim"), "other")
    best = lambda df: df.groupBy("key").agg(F.max(F.struct("sim", (-F.col("other")).alias("o"))).alias("m")).select("key", F.col("m.sim").alias("sim"), (-F.col("m.o")).alias("other"))
    found = best(scored)
    # what words that more than RARE texts have could reach: a text holding all of them and nothing else
    frequent = ours.where(F.col("df") > RARE).groupBy("key").agg(F.count(F.lit(1)).alias("f"), F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("fn"))
    reach = (F.col("f") / F.size("words") + F.col("fn") / _norm(F.col("words"))) / 2
    unsure = a.join(frequent, "key").join(found.select("key", "sim"), "key", "left").where(F.coalesce(reach + 1e-8 >= F.col("sim"), F.lit(True))).select("key", "words")
    unsure = cut(unsure, "unsure")
    n, m = max(1, -(-unsure.count() // ROWS)), max(1, -(-texts.count() // TEXTS))
    deal, every = (lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")), (lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    x = unsure.withColumn("x", deal("key", n)).withColumn("y", every(m)).groupBy("x", "y")
    y = b.select("id", "words").withColumn("y", deal("id", m)).withColumn("x", every(n)).groupBy("x", "y")
    most = best(found.unionByName(x.cogroup(y).applyInArrow(_in_blocks, OUT)))
    keyed = rows.where(F.size("tokens") > 0).select("id", F.array_join(F.array_sort("tokens"), " ").alias("key"), F.pmod(F.xxhash64("id"), F.lit(LANES)).alias("lane"))
    dealt = most.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))))
    return keyed.join(dealt, ["key", "lane"]).select("id", "sim", F.col("other").alias("best_id"))


def _block(key, texts, width: int):
    """One row of ``BLOCK`` from (block, doc_id, text). The last id may be the first of the next block, whose texts that counts."""
    import numpy as np
    import pyarrow.compute as pc

    tokens = pc.split_pattern(texts.column("text").combine_chunks(), " ")
    ids, of = np.unique(texts.column("doc_id").to_numpy(), return_inverse=True)
    coded = tokens.flatten().dictionary_encode()
    size = len(coded.dictionary)
    found, n = np.unique(np.repeat(of, np.diff(tokens.offsets.to_numpy())) * size + coded.indices.to_numpy(), return_counts=True)
    doc, word = found // size, found % size
    own = np.bincount(word[ids[doc] // width == key[0].as_py()], minlength=size)
    starts = np.searchsorted(doc, np.arange(len(ids) + 1))
    ints = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "starts": ints(starts), "of": ints(word), "n": ints(n), "words": pa.array([coded.dictionary], pa.list_(pa.string())), "own": ints(own)})


def next_cosine(docs: DataFrame, total: int) -> DataFrame:
    """(doc_id, sim): the TF-IDF cosine of each text and that of the next id, where both have words; words weigh the logarithm of ``total`` over the ids that have them.

    docs: (doc_id, tokens); words hold no space. Texts of one id are one; those without an id count as one in the weights.
    """
    texts = docs.where(F.size("tokens") > 0)
    width = IDS
    place = F.expr(f"(doc_id - pmod(doc_id, {width})) div {width}")
    dealt = texts.where("doc_id is not null").select("doc_id", F.array_join("tokens", " ").alias("text"), F.explode(F.when(F.expr(f"pmod(doc_id, {width}) = 0"), F.array(place, place - 1)).otherwise(F.array(place))).alias("block"))
    blocks = cut(dealt.groupBy("block").applyInArrow(lambda key, texts: _block(key, texts, width), BLOCK), "blocks")
    no_id = cut(texts.where("doc_id is null").select(F.explode("tokens").alias("w")).distinct(), "no_id")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "own")).alias("at", "x")).select("block", "at", F.col("x.words").alias("w"), F.col("x.own").alias("own"))
    words = words.unionByName(no_id.select(F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("at"), "w", F.lit(1).alias("own")))
    held = cut(words.select("block", "at", F.sum("own").over(Window.partitionBy("w")).alias("df")).where("block is not null and df > 1"), "held")

    def compared(key, left, right):
        import numpy as np

        block = {c: left.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "starts", "of", "n")}
        ids, word = block["ids"], block["of"].astype(np.int64)
        # a word that is not among those of several ids is one of one
        df = np.ones(word.max() + 1)
        df[right.column("at").to_numpy()] = right.column("df").to_numpy()
        weight, doc = block["n"] * np.log(total / df)[word], np.repeat(np.arange(len(ids)), np.diff(block["starts"]))
        norm = np.sqrt(np.bincount(doc, weight * weight, len(ids)))
        first = np.flatnonzero(ids[1:] == ids[:-1] + 1)
        keys = doc * len(df) + word
        wanted = (doc - 1) * len(df) + word
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        met = np.flatnonzero(keys[at] == wanted)
        dot = np.bincount(doc[at[met]], weight[met] * weight[at[met]], len(ids))
        both = norm[first] * norm[first + 1]
        sim = np.divide(dot[first], both, out=np.zeros(len(first)), where=both > 0)
        return pa.table({"doc_id": pa.array(ids[first], pa.int64()), "sim": pa.array(sim, pa.float64())})

    return blocks.drop("words", "own").groupBy("block").cogroup(held.groupBy("block")).applyInArrow(compared, "doc_id long, sim double")
