"""Reading level of running English text.

One pass reads each text: the complexity of its sentences (words, and letters a word, of
the middle sentence), what tells prose from logs, code and tables, and its words with
their counts, which are kept. The rest works on the counts: a word's rank is the number
of words at least as frequent in the corpus, and a text's ranks are the smallest
frequency-ranked vocabularies that cover fixed shares of its words. What English looks
like is learned from the rated texts, which are English prose: the words that stand in
many of them, and how large a share these make up. Calibration and banding are SQL over
the features: from the rated documents the middle of each feature in each band and the
usual distance from it, robust against wrong ratings; a document gets the band that it
is nearest to, every feature counting alike.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from weft.llm.leaks import without_markup
from weft.sources.tables import forget, keep

#: Shares of a document's words that its vocabularies must cover: the core of the text, and nearly all of it.
COVERS = (0.6, 0.8)
#: Words up to which ranks are broadcast (about 60 MB); beyond, they are joined.
VOCABULARY = 1_000_000
#: Rated texts at most that English is learned from, a sample by hash; words that stand in that share of them are everyday words.
RATED_TEXTS, EVERYDAY = 20_000, 0.3
#: What counts as running English text: words, share of everyday words against the rated texts' middle share, share of words in lines that read as sentences.
LEAST_WORDS, LEAST_COMMON, LEAST_SENTENCE = 50, 0.4, 0.65
#: Squared distance from a band, in usual ones, from which on a feature tells no more.
FAR = 16.0

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LETTER = re.compile(r"[^\W_]")
#: Share of a line's characters that letters and blanks make up in a sentence.
_MOSTLY = 0.82
#: Rulers and figures say nothing of whether a line is a sentence.
_RULER = re.compile(r"([^\w\s])\1{3,}|\d[\d.,:]*")
_SENTENCE_END = re.compile(r"[.!?]+[\"”’)\]]*(?=\s|$)")

COUNTED = "doc_id long, n_words int, sentence_like double, sentence_words double, sentence_letters double, words array<string>, counts array<int>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(text: str) -> dict:
    """What one text says without the corpus, and its words' counts."""
    plain = without_markup(text)[0]
    words: list[str] = []
    like = total = 0
    lengths, letters = [], []
    for line in plain.split("\n"):
        line = line.strip()
        if not line:
            continue
        k = size = 0
        for sentence in _SENTENCE_END.split(line.lower()):
            found = _WORD.findall(sentence)
            n = len(found)
            if n:
                words += found
                k += n
                chars = len("".join(found))
                size += chars
                if n >= 3:
                    lengths.append(n)
                    letters.append(chars / n)
        total += k
        # Letters and blanks make up a sentence; only where they seem too few are rulers and figures taken off.
        if k >= 3 and (size + line.count(" ") >= _MOSTLY * len(line) or size + line.count(" ") >= _MOSTLY * len(_RULER.sub("", line))):
            like += k
    counts = Counter(words)
    tokens = plain.split()
    n_words = len(tokens) - sum(1 for t in [t for t in tokens if not t[0].isalnum()] if not _LETTER.search(t))
    middle = lambda v: float((sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2) if v else 0.0
    return {"n_words": n_words, "sentence_like": like / total if total else 0.0, "sentence_words": middle(lengths), "sentence_letters": middle(letters), "counts": counts}


def covering_ranks(doc: np.ndarray, rank: np.ndarray, count: np.ndarray, n: int, covers: tuple[float, ...]) -> list[np.ndarray]:
    """For each share, of each of n texts the smallest rank such that words up to it make up the share, from text number, rank and count of each word; 0 for a text without words."""
    order = np.lexsort((rank, doc))
    doc, rank, count = doc[order], rank[order], count[order]
    total = np.bincount(doc, count, n)
    seen = np.cumsum(count) - (np.cumsum(total) - total)[doc]
    out = []
    for cover in covers:
        need = np.ceil(cover * total - 1e-9)[doc]
        reached = (seen >= need) & (seen - count < need)  # the one word of a text that closes the share
        found = np.zeros(n)
        found[doc[reached]] = rank[reached]
        out.append(found)
    return out


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, the features of each text (doc_id, text) and its distinct words with their counts: the only pass over texts."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for batch in batches:
            for a in range(0, len(batch), 1_000):
                rows = []
                for doc, t in zip(batch.column(0).slice(a, 1_000).to_pylist(), batch.column(1).slice(a, 1_000)):
                    f = features(t.as_py())
                    counts = f.pop("counts")
                    rows.append((doc, *f.values(), list(counts), list(counts.values())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kind = _parse_datatype_string(COUNTED)
    return docs.mapInArrow(run, COUNTED)


def _each_word(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("doc_id", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))


def vocabulary(found: DataFrame) -> DataFrame:
    """word, n, rank over all counted texts; rank is the number of words at least as frequent, so ties share one."""
    words = keep(_each_word(found).groupBy("word").agg(F.sum("n").alias("n")))
    # Distinct frequencies are few (below the root of twice the corpus's words), so their running count may be one task's.
    by_n = words.groupBy("n").agg(F.count("*").alias("words"))
    ranks = by_n.select("n", F.sum("words").over(Window.orderBy(F.col("n").desc())).alias("rank"))
    return keep(words.join(ranks, "n").select("word", "n", "rank"))


def everyday_words(found: DataFrame, ratings: DataFrame, share: float = EVERYDAY, most: int = RATED_TEXTS) -> frozenset[str]:
    """Words that stand in at least that share of the rated texts, of counted ones. At most 1 / share times a text's distinct words, so few."""
    rated = ratings.where("band is not null and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = keep(found.join(F.broadcast(rated), "doc_id", "left_semi").where(F.size("words") > 0).select("doc_id", "words", "counts"))
    n = texts.count()
    return frozenset(r.word for r in _each_word(texts).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= share * n).select("word").collect())


def document_features(found: DataFrame, ranks: DataFrame, everyday: frozenset[str], covers: tuple[float, float] = COVERS, most: int = VOCABULARY) -> DataFrame:
    """doc_id and features of each counted text, share of everyday words and vocabulary ranks included.

    Ranks are looked up in each task where the vocabulary is small enough to be broadcast, else joined.
    """
    plain = ["doc_id", "n_words", "sentence_like", "sentence_words", "sentence_letters"]
    if ranks.count() <= most:
        words = ranks.select("word", "rank").toArrow()
        shared = found.sparkSession.sparkContext.broadcast((words["word"].to_pylist(), words["rank"].to_numpy(), everyday))

        def run(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            known, rank, common = shared.value
            lookup, is_common = pa.array(known, pa.string()), np.array([w in common for w in known], bool)
            for batch in batches:
                own, counts = batch.column(len(plain)), batch.column(len(plain) + 1)
                sizes = pc.list_value_length(own).to_numpy(zero_copy_only=False)
                doc, count = np.repeat(np.arange(len(own)), sizes), counts.flatten().to_numpy().astype(float)
                at = pc.index_in(own.flatten(), value_set=lookup).to_numpy(zero_copy_only=False).astype("int64")  # every word is in the vocabulary
                total = np.bincount(doc, count, len(own))
                share = np.bincount(doc, count * is_common[at], len(own)) / np.maximum(total, 1)
                extra = [share, *covering_ranks(doc, rank[at].astype(float), count, len(own), covers)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(plain))), *map(pa.array, extra)], names=[*plain, "common", "core_rank", "wide_rank"])

        return found.select(*plain, "words", "counts").mapInArrow(run, "doc_id long, n_words int, sentence_like double, sentence_words double, sentence_letters double, common double, core_rank double, wide_rank double")

    # Repeated documents have one id; each row is a text of its own.
    numbered = keep(found.withColumn("row", F.monotonically_increasing_id()))
    each = numbered.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    is_common = F.col("word").isin(*everyday) if everyday else F.lit(False)
    ranked = each.join(ranks.select("word", "rank"), "word").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "n"))).alias("r"), F.sum("n").alias("total"), F.sum(F.when(is_common, F.col("n")).otherwise(0)).alias("common"))

    def reached(cover: float) -> Column:
        enough = F.ceil(F.lit(cover) * F.col("total") - 1e-9)
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("rank"))
        step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["rank"], F.when(a["seen"] + x["n"] >= enough, x["rank"].cast("double"))).alias("rank"))
        return F.aggregate("r", start, step)["rank"]

    told = ranked.select("row", (F.col("common") / F.col("total")).alias("common"), reached(covers[0]).alias("core_rank"), reached(covers[1]).alias("wide_rank"))
    return numbered.select("row", *plain).join(told, "row", "left").drop("row").fillna(0.0, ["common", "core_rank", "wide_rank"])


#: The scale's features, as SQL over document_features.
_SCALE = {"core": "ln(core_rank + 1)", "wide": "ln(wide_rank + 1)", "length": "ln(sentence_words + 1)", "letters": "ln(sentence_letters + 1)"}

_RATED = f"select l.band, f.common, {', '.join(f'{x} as {k}' for k, x in _SCALE.items())} from {{features}} f join {{ratings}} l on f.doc_id = l.doc_id where l.band is not null"

#: The middle of each feature in each band: one row for each band of the scale.
_MIDDLE = f"select band, {', '.join(f'percentile_approx({k}, 0.5, 10000) as {k}' for k in _SCALE)} from {{rated}} group by band order by band limit {{most}}"

#: The usual distance from a band's middle, in one row, and the middle share of everyday words.
_SPREAD = f"""
select percentile_approx(r.common, 0.5, 10000) as common, {', '.join(f'greatest(1.4826 * percentile_approx(abs(r.{k} - m.{k}), 0.5, 10000), 0.01) as {k}' for k in _SCALE)}
from {{rated}} r join {{middle}} m on r.band = m.band
"""

#: Bands that a scale may have.
MOST_BANDS = 100


def prose(found: DataFrame, least_common: float) -> DataFrame:
    """Documents that are mainly running English text: enough words, enough of them everyday words, and lines that read as sentences."""
    return found.where((F.col("n_words") >= LEAST_WORDS) & (F.col("common") >= least_common) & (F.col("sentence_like") >= LEAST_SENTENCE))


def reading_bands(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", covers: tuple[float, float] = COVERS, most: int = VOCABULARY, scale: tuple[str, ...] = tuple(_SCALE)) -> DataFrame:
    """doc_id, band of each document that is mainly running English text.

    The vocabulary and every feature come from whole texts of all documents; ratings place the
    bands and teach what English looks like. scale names the features that decide, all alike.
    Defined cases: null, blank and short texts have no band; repeated documents count
    each; several ratings of a document count each; ratings with a null band or of unknown
    documents don't count; without any rating there are no rows; other columns aren't read.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("band").cast("int").alias("band"))
    texts = keep(counted(source))
    found = keep(document_features(texts, vocabulary(texts), everyday_words(texts, rated), covers, most))
    forget(texts)
    spark = docs.sparkSession
    told = keep(spark.sql(_RATED, features=found, ratings=rated))
    middle = keep(spark.sql(_MIDDLE, rated=told, most=MOST_BANDS + 1))
    bands, spread = middle.collect(), spark.sql(_SPREAD, rated=told, middle=middle).first()
    if len(bands) > MOST_BANDS:
        raise ValueError(f"more than {MOST_BANDS} bands")
    if not bands:
        return found.select("doc_id", F.lit(0).alias("band")).where(F.lit(False))
    # The scale is a handful of numbers now, so each text is banded where it lies.
    off = lambda b, k: F.least(F.lit(FAR), F.pow((F.expr(_SCALE[k]) - F.lit(b[k])) / F.lit(spread[k]), 2))
    far = [F.struct(reduce(lambda x, y: x + y, (off(b, k) for k in scale)).alias("distance"), F.lit(b.band).alias("band")) for b in bands]
    return prose(found, LEAST_COMMON * spread.common).select("doc_id", F.array_min(F.array(*far))["band"].alias("band"))
