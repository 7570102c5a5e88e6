"""Gates, category scores and selections over items and candidates. All are DataFrame in, DataFrame out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnowry.functions import rules
from winnowry.functions.text import any_part, any_phrase, any_word, matches_any, once, worded


def ranked(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_wins(df: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """The first row of each key in ingest order."""
    return ranked(df.withColumn("_k", key), ["_k"], [pos], "_r").where("_r = 1").drop("_k", "_r")


def fresh(df: DataFrame, as_of: str, hours: int, ts: str = "published_at") -> DataFrame:
    """Rows without a date, or not older than so many hours at as_of."""
    return df.where(F.col(ts).isNull() | (F.col(ts) >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {hours} hours")))


def hard_reject(text: str, low: Column | None = None, held: Column | None = None) -> Column:
    """Reason: null result, two admin terms, promotion, local program, in this order; else null. ``low`` and ``held`` are the text in lower case and its different words in a row, where they are known."""
    low = F.lower(text) if low is None else low
    found = lambda p: any_part(low, rules.REJECT_PARTS[p], held) & low.rlike(p)
    first = lambda listed: F.coalesce(*[F.when(found(p), F.lit(name)) for name, p in listed])
    admin = reduce(lambda a, b: a + b, [found(p).cast("int") for _, p in rules.ADMIN])
    return F.coalesce(first(rules.NULL_RESULT), F.when(admin >= 2, F.lit("admin")), first(rules.PROMO), first(rules.LOCAL))


def short_body(paper: int = 600, other: int = 1200) -> Column:
    return F.when(F.length("body_text") < F.when(F.col("content_type") == "paper", paper).otherwise(other), F.lit("too short"))


def truism(title: str = "title", body: str = "body_text") -> Column:
    """Reason if the title is a truism and neither it nor the body has anything specific."""
    said = lambda c, listed: matches_any(F.lower(c), [p for _, p in listed])
    return F.when(said(title, rules.TRUISMS) & ~said(title, rules.DIFFERENTIATORS) & ~said(body, rules.DIFFERENTIATORS), F.lit("truism"))


def headline_fault(h: str = "title", least: int = 30, most: int = 300) -> Column:
    t = F.trim(h)
    return F.coalesce(F.when(F.col(h).isNull() | (t == ""), F.lit("empty")), F.when(F.length(t) < least, F.lit("short")), F.when(F.length(t) > most, F.lit("long")), F.when(~t.rlike("[0-9]"), F.lit("no digit")), F.when(t.rlike("^[A-Z][A-Za-z ]*:"), F.lit("prefix")), F.when(t.contains("!"), F.lit("exclaim")))


def said(low: Column, name: str, pattern: str, held: Column | None = None) -> Column:
    """Whether the text holds what the flag asks for: a word of its list, by the text's words; phrases and all else by pattern."""
    if name not in rules.LEXICONS:
        return any_part(low, rules.NEEDED[name], held) & low.rlike(pattern) if name in rules.NEEDED else low.rlike(pattern)
    single, phrases = rules.LEXICONS[name]
    found = any_word(single)
    return found | (any_phrase(phrases) & low.rlike(rules.words(phrases))) if phrases else found


def categorised(df: DataFrame, text: str = "title", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds category, category_score, confidence and reasons (flags of the best scorecard): ties by order; below the floor NONE.

    ``keep``: which of _low, _words and _held (the text in lower case, its different words, these in a row) stay.
    """
    df = worded(df, text).withColumn("_held", once(F.concat_ws(" ", "_words")))
    low = F.col("_low")
    bits = [F.when(said(low, name, p, F.col("_held")), 1 << i).otherwise(0) for i, (name, p) in enumerate(rules.FLAGS.items())]
    df = df.withColumn("_flags", F.coalesce(once(reduce(lambda a, b: a + b, bits)), F.lit(0)))
    flags = {name: F.col("_flags").bitwiseAND(F.lit(1 << i)) > 0 for i, name in enumerate(rules.FLAGS)}
    flags["symptom|body"] = flags["symptom"] | flags["body"]
    cards, told, named = [], [], []
    for i, (name, points) in enumerate(rules.SCORECARDS):
        total = reduce(lambda a, b: a + b, [F.when(flags[f], n).otherwise(0) for f, n in points.items()])
        cards.append(F.struct(total.alias("score"), F.lit(-i).alias("order")))
        named.append(F.when(F.col("_best.order") == -i, F.lit(name)))
        told.append(F.when(F.col("_best.order") == -i, F.concat_ws(",", *[F.when(flags[f], f) for f in points])))
    df = df.withColumn("_cards", F.array(*cards)).withColumn("_best", F.array_max("_cards"))
    enough = F.col("_best.score") >= rules.FLOOR
    total = F.aggregate("_cards", F.lit(0), lambda a, c: a + c["score"])
    return df.withColumn("category", F.when(enough, F.coalesce(*named)).otherwise("NONE")).withColumn("category_score", F.when(enough, F.col("_best.score")).otherwise(0)).withColumn("confidence", F.when(enough, F.col("_best.score") / total).otherwise(0.0)).withColumn("reasons", F.when(enough, F.coalesce(*told)).otherwise("")).drop("_cards", "_best", "_flags", *({"_words", "_low", "_held"} - set(keep)))


def capped(df: DataFrame, run: list, order: list, key: Column, cap: int | None, most: int) -> DataFrame:
    """In order, at most cap rows of a key (where it is not null), then the first so many of a run."""
    df = ranked(df.withColumn("_key", key), [*run, "_key"], order, "_in")
    return ranked(df.where(F.col("_key").isNull() | (F.col("_in") <= cap)), run, order).where(F.col("rank") <= most).drop("_key", "_in")


def interleaved(df: DataFrame, most: int, study_cap: int = 2, other_cap: int = 2, least_other: int = 1, run: str = "run_id", overflow: bool = True) -> DataFrame:
    """The mixer in closed form: other archetypes within their cap first, each followed by a study one; with ``overflow``, studies beyond the
    cap fill up what is left; what is taken is ordered by score. A null archetype is a study.

    Rows that no run could take any more go by their rank in run and archetype, before runs come together.
    """
    kind = F.coalesce("archetype", F.lit("STUDY_STAT"))
    df = df.withColumn("_kind", kind).withColumn("_study", kind == "STUDY_STAT")
    df = ranked(df, [run, "_kind"], ["pos"], "_of").where(F.col("_of") <= max(most, other_cap))
    df = df.where(F.when(F.col("_study"), F.lit(overflow) | (F.col("_of") <= study_cap)).otherwise(F.col("_of") <= other_cap))
    line = Window.partitionBy(run).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_k", F.sum(F.when(F.col("_study"), 0).otherwise(1)).over(line))
    inner = F.col("_study") & (F.col("_of") <= study_cap)
    slot = lambda a, b, c: F.struct(F.lit(a).alias("a"), b.alias("b"), F.lit(c).alias("c"))
    place = F.when(~F.col("_study"), slot(0, F.col("_k"), 0)).when(inner, slot(0, F.lit(max(least_other, 1)) + F.col("_of") - 1, 1)).otherwise(slot(1, F.col("_of"), 1))
    df = ranked(df.withColumn("_slot", place), [run], ["_slot", "pos"], "_pick").where(F.col("_pick") <= most)
    return ranked(df, [run], [F.desc("score"), "_pick"]).drop("_kind", "_study", "_of", "_k", "_slot", "_pick")


BLOCK_ROWS = 4096
#: Rows of a block whose similarities a task holds at once.
AT_ONCE = 256


def _best_of_blocks(earlier: bool):
    def run(key, rows, corpus):
        import numpy as np
        import pyarrow as pa

        if not rows.num_rows or not corpus.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64()), "other": pa.array([], pa.int64())})

        def unit(t):
            m = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            n = np.sqrt((m * m).sum(1, keepdims=True))
            return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

        corpus = corpus.sort_by("id")
        left, right = unit(rows), unit(corpus).T
        ids, others, found = rows.column("id").to_numpy(), corpus.column("id").to_numpy(), []
        for lo in range(0, len(ids), AT_ONCE):
            sims, own = np.round(left[lo : lo + AT_ONCE] @ right, 9), ids[lo : lo + AT_ONCE]
            if earlier:
                sims[others[None, :] >= own[:, None]] = -np.inf
            at = sims.argmax(1)
            best = sims[np.arange(len(at)), at]
            met = np.flatnonzero(best > -np.inf)
            found.append((own[met], best[met], others[at[met]]))
        return pa.table(dict(zip(("id", "sim", "other"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def cosine_best(rows: DataFrame, corpus: DataFrame, earlier: bool = False) -> DataFrame:
    """Each row's most similar corpus vector, to nine places; zero norms give 0; the smallest id of ties wins. ``earlier``: of those of smaller ids only.

    rows and corpus: (id, v of doubles, of one dimension). Blocks of both meet in a task each, as matrix products, and give one row for each of their rows.
    """
    parts = lambda df: max(1, -(-df.count() // BLOCK_ROWS))
    own = [F.col(c).alias(c) for c in ("id", "v")]  # both sides may come of one table
    rows, corpus = rows.select(*own), corpus.select(*own)
    n, m = parts(rows), parts(corpus)
    deal, every = (lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")), (lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    x = rows.withColumn("x", deal(n)).withColumn("y", every(m)).groupBy("x", "y")
    y = corpus.withColumn("y", deal(m)).withColumn("x", every(n)).groupBy("x", "y")
    best = x.cogroup(y).applyInArrow(_best_of_blocks(earlier), "id long, sim double, other long")
    return best.groupBy("id").agg(F.max(F.struct("sim", (-F.col("other")).alias("o"))).alias("m")).select("id", F.col("m.sim").alias("sim"), (-F.col("m.o")).alias("best_id"))


def tier_sample(df: DataFrame, n: int, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """``n`` rows without replacement: each tier's share by weighted random keys, what is missing from the rest by the same keys.

    df: item_id, tier, weight. Keys are hashes, so reruns agree. A tier smaller than its share is taken whole.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("item_id").cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    keyed = df.withColumn("_k", -F.log(u) / F.col("weight"))
    quota = F.coalesce(*[F.when(F.col("tier") == t, int(n * s)) for t, s in shares.items()], F.lit(0))
    inside = ranked(keyed, ["tier"], ["_k", "item_id"], "_i").where(F.col("_i") <= n).withColumn("_first", F.col("_i") <= quota)  # no tier gives more than n
    return inside.orderBy(F.desc("_first"), "_k", "item_id").limit(n).drop("_k", "_i", "_first")
