"""Language identification by a bit-sliced Bloom filter over character n-grams.

The filter has `bits` positions, and each position holds one bit for each language, in as many 64-bit
words as the languages need: the mask of the languages that set it. The AND of an n-gram's positions is
the mask of all languages that may hold it, in one lookup. A text's n-grams are counted for each
language, the count expected from the filter's false positives is taken off, and the largest share
decides.

Learning: `sample` labelled rows of each language (those of the smallest digests of id and text, a
documented bound), whole texts; rows of one id and text are one. The digests that a language may need
are told by an estimate of how many it has, so no task sees more than a few times `sample` rows of a
language. An n-gram is learned for a language if at least `least` of the sample's texts hold it, or all
of a smaller sample. The filter is a table of at most `bits` rows for every 64 languages, collected and
broadcast.

Null texts, and texts without a letter, are `und` with score 0; so is every text if nothing could be
learned. All labels are learned, however many and however rare. Repeated rows give repeated results;
ties go to the language that sorts first. An empty table gives an empty result. Extra columns pass
through, columns named as results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.llm.common import U64, cut, mix, slices

#: The production parameters: positions of the filter, hashes of an n-gram, bytes of an n-gram, rows learned of a language, texts that must hold an n-gram.
BITS = 1 << 20
HASHES = 2
NGRAM = 5
SAMPLE = 400
LEAST = 3
#: Times `sample` of a language's rows that are looked at, so that an estimate a little high still finds them.
SPARE = 2.5
UNDETERMINED = "und"
#: Characters of a long text that are counted at a time.
PIECE = 2_000_000


def grams(texts: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of bytes of all lower-case texts, each text's first and number.

    What is no letter is a space, and runs of spaces are one; a space is set before and after each text.
    """
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    clean = pc.binary_join_element_wise("", pc.utf8_trim(clean, " "), "", " ")
    size = np.asarray(pc.binary_length(clean), dtype=np.int64)
    data = np.frombuffer(b"".join(clean.cast(pa.binary()).to_pylist()), np.uint8).astype(U64)
    if len(data) < n:
        data = np.concatenate([data, np.zeros(n, U64)])
    h = np.zeros(len(data) - n + 1, U64)
    for i in range(n):
        h = (h << U64(8)) | data[i : i + len(h)]
    end = np.cumsum(size)
    return mix(h), end - size, np.maximum(0, size - n + 1)


def positions(h: np.ndarray, bits: int = BITS, hashes: int = HASHES) -> Iterator[np.ndarray]:
    for i in range(hashes):
        yield ((h >> U64(32 * i)) & U64(bits - 1)).astype(np.int64)


class LanguageFilter:
    def __init__(self, languages: list[str], table: np.ndarray, hashes: int = HASHES, n: int = NGRAM):
        """table: the masks of all positions; with more than 64 languages, a row of masks for every 64."""
        self.languages, self.table, self.hashes, self.n = languages, np.atleast_2d(table), hashes, n
        filled = np.array([np.count_nonzero(self.table[i // 64] & U64(1 << i % 64)) for i in range(len(languages))]) / self.table.shape[1]
        self.false = filled**hashes

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the n-grams that each language may hold, and all. A very long text goes in pieces, whose counts add up."""
        if len(texts) != 1 or len(texts[0].as_py() or "") <= PIECE:
            return self._counts(texts)
        text, at, hits, count = texts[0].as_py(), 0, 0, 0
        while at < len(text):
            space = re.compile(r"\s").search(text, at + PIECE, at + 2 * PIECE)
            end = space.end() if space else at + PIECE
            found = self._counts(pa.array([text[at:end]]))
            hits, count, at = hits + found[0], count + found[1], end
        return hits, count

    def _counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h, first, count = grams(texts, self.n)
        hits = np.zeros((len(texts), len(self.languages)), np.int64)
        for i in range(len(self.languages)):
            if i % 64 == 0:
                masks = np.full(len(h), ~U64(0), U64)
                for p in positions(h, self.table.shape[1], self.hashes):
                    masks &= self.table[i // 64][p]
            total = np.concatenate([[0], np.cumsum((masks >> U64(i % 64)) & U64(1))])
            hits[:, i] = total[np.minimum(first + count, len(h))] - total[np.minimum(first, len(h))]
        return hits, count

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text."""
        return self.judged(texts)[:2]

    def judged(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1) and number of n-grams of each text."""
        hits, count = self.counts(texts)
        share = np.clip((hits / np.maximum(count, 1)[:, None] - self.false) / (1 - np.minimum(self.false, 0.999)), 0, 1)
        letter = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), count
        best = share.argmax(axis=1)
        score = np.where(letter, share[np.arange(len(best)), best], 0.0)
        return [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), letter.tolist(), strict=True)], score, count


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, bits: int = BITS, hashes: int = HASHES, n: int = NGRAM, least: int = LEAST) -> LanguageFilter:
    """The filter of a bounded sample of labelled rows."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.xxhash64(F.col(key).cast("string"), text).alias("_h"))
    sizes = rows.groupBy("_lang").agg(F.approx_count_distinct("_h", 0.02)).collect()
    share = {x: min(1.0, SPARE * sample / max(n, 1)) for x, n in sizes}
    most = spark.createDataFrame([(x, (1 << 63) - 1 if s == 1 else int(s * 2**64) - 2**63) for x, s in share.items()], "_lang string, _most long")
    near = cut(rows.join(F.broadcast(most), "_lang").where("_h <= _most").groupBy("_lang", "_h").agg(F.first("_text").alias("_text")))
    picked = near.select("_lang", "_h").withColumn("_k", F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))).where(F.col("_k") <= sample)
    bounds = sorted(tuple(r) for r in picked.groupBy("_lang").agg(F.max("_h"), F.count("*")).collect())
    languages = [x for x, _, _ in bounds]
    words = max(1, -(-len(languages) // 64))
    if not bounds:
        return LanguageFilter([], np.zeros(bits, U64), hashes, n)
    known = F.broadcast(spark.createDataFrame([(x, most, i, min(least, held)) for i, (x, most, held) in enumerate(bounds)], "_lang string, _most long, _l int, _least long"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            h, first, count = grams(b["_text"], n)
            for at, k, x in zip(first.tolist(), count.tolist(), b["_l"].to_pylist(), strict=True):
                found = np.unique(h[at : at + k])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), x, np.int32))], names=["_g", "_l"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, of = b["_g"].to_numpy().view(U64), b["_l"].to_numpy().astype(np.int64)
            mask = np.int64(1) << of % 64
            for p in positions(h, bits, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(of // 64 * bits + p), pa.array(mask)], names=["_p", "_m"])

    seen = near.join(known, "_lang").where("_h <= _most").select("_text", "_l").mapInArrow(extract, "_g long, _l int")
    common = seen.groupBy("_g", "_l").agg(F.count("*").alias("_n")).join(known, "_l").where("_n >= _least")
    masks = common.select("_g", "_l").mapInArrow(place, "_p long, _m long").groupBy("_p").agg(F.bit_or("_m").alias("_m")).toArrow()
    table = np.zeros(words * bits, U64)
    table[masks["_p"].to_numpy()] = masks["_m"].to_numpy().view(U64)
    return LanguageFilter(languages, table.reshape(words, bits), hashes, n)


def predict(df: DataFrame, model: LanguageFilter, text: str = "text", n_grams: bool = False) -> DataFrame:
    """df with lang_pred and score of each text, and its number of n-grams if asked for."""
    held = df.sparkSession.sparkContext.broadcast(model)
    fields = T._parse_datatype_string("lang_pred string, score double" + (", n_grams long" if n_grams else "")).fields
    kept = [c for c in df.columns if c not in {f.name for f in fields}]
    needed = [*kept, *([text] if text not in kept else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 500_000):
            lang, score, count = held.value.judged(b[text])
            found = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *found[: len(fields)]], names=[*kept, *(f.name for f in fields)])

    return df.select(*needed).mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), *fields]))
