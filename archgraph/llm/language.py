"""Language identification by compression.

Each language has a raw-content zstandard dictionary: its most frequent words, the commonest last, where matches are
cheapest. A text, folded to lower-case words, is compressed whole, in pieces, with every dictionary; the language
of the smallest total wins. The text counts as a ring, so every piece has PIECE_BYTES: the last one, which may be the only one, goes
on with the beginning. Where the best and the next differ by less than MARGIN of the text's bytes it is rejected.

Training: at most SAMPLE_DOCUMENTS different texts for each language, those of least hash among rows that are not held out. All
dictionaries together take at most MODEL_BYTES: beyond MODEL_BYTES / DICTIONARY_BYTES languages each gets an equal share.

Cases: a very long text is compressed whole, piece by piece; a word of any length is learned in parts; a null text or one without a letter is `und` with score 0 and rejected; ties go to the first language by
name; with no training rows everything is `und`; rows without an id are not trained on; repeated rows count once in training and
get equal results; an empty table gives no rows; a column that has a result's name is an error, which `prefix` avoids.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archgraph.llm.common import appended, dropped, held_out, written

DICTIONARY_BYTES, MODEL_BYTES, PIECE_BYTES, LEVEL = 1 << 16, 1 << 25, 512, 6
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 400, 16_384
MARGIN, SHARPNESS = 0.003, 50.0
UNKNOWN = "und"
#: One folding for both sides: letters and the marks that belong to them; a training word of more than WORD_LETTERS is taken in parts, so that each fits.
NOT_LETTERS, WORD_LETTERS = r"[^\p{L}\p{M}]+", 64
PARTS = NOT_LETTERS.replace("^", "").rstrip("+") + f"{{1,{WORD_LETTERS}}}"
FOLDED = regex.compile(NOT_LETTERS)


def dictionaries(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """One dictionary for each language of the training rows."""
    train = df.filter(~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    train = train.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    different = train.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))
    # Hashes are even: below a share of their range that follows from the count lie about twice the rows wanted, however large the table.
    # Tables are written, so that the size is known by which Spark chooses to broadcast them or not.
    shares = written(different.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_DOCUMENTS) / F.count("*")).alias("share")))
    near = different.join(shares, "lang").filter(F.col("h").cast("double") <= F.col("share") * 2.0**64 - 2.0**63)
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = written(near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLE_DOCUMENTS).select("lang", "h", "doc_id"))
    words = train.join(chosen, ["lang", "h", "doc_id"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(PARTS), F.lit(0))).alias("word"))
    ranked = words.groupBy("lang", "word").count().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).filter(F.col("n") <= SAMPLE_WORDS)
    # The words of a dictionary: those whose running size fits, still in Spark, so that no more than the model reaches the driver.
    languages = max(1, shares.count())
    upto = Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    sized = ranked.withColumn("size", F.sum(F.octet_length("word") + 1).over(upto)).filter(F.col("size") <= min(DICTIONARY_BYTES, MODEL_BYTES // languages))
    out: dict[str, list[bytes]] = {}
    for name, word, _ in sorted(sized.select("lang", "word", "n").collect(), key=lambda r: (r[0], r[2])):
        out.setdefault(name, []).append(word.encode() + b" ")
    for table in (shares, chosen):
        dropped(table)
    return {name: b" " + b"".join(reversed(parts)) for name, parts in out.items()}


class Compressors:
    def __init__(self, contents: dict[str, bytes]):
        self.names = sorted(contents)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.all = []
        for name in self.names:
            held = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            self.all.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress)

    def of(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)."""
        folded = FOLDED.sub(" ", (text or "").lower())
        if not self.all or not any(map(str.isalpha, folded)):
            return UNKNOWN, 0.0, 0.0, True
        raw = f" {folded.strip()} ".encode("utf-8", "surrogatepass")
        size = len(raw)
        rest = -size % PIECE_BYTES
        raw += (raw * (rest // size + 1))[:rest]
        pieces = [raw[k : k + PIECE_BYTES] for k in range(0, len(raw), PIECE_BYTES)]
        rates = [sum(map(len, map(compress, pieces))) / size for compress in self.all]
        best = min(rates)
        others = sorted(rates)[1:]
        margin = others[0] - best if others else 1.0
        score = 1 / (1 + sum(math.exp(-SHARPNESS * (x - best)) for x in others))
        return self.names[rates.index(best)], score, margin, margin < MARGIN


def identify(df: DataFrame, contents: dict[str, bytes], text: str = "text", keep: tuple[str, ...] | None = None, prefix: str = "") -> DataFrame:
    """The frame's columns (or `keep`) with lang_pred, score, margin and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(contents)

    def start():
        compressors = Compressors(shared.value)

        def of(column):
            rows = [compressors.of(t.as_py()) for t in column]
            names, scores, margins, rejected = zip(*rows) if rows else ((), (), (), ())
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())]

        return of

    return appended(df, text, {f"{prefix}lang_pred": "string", f"{prefix}score": "double", f"{prefix}margin": "double", f"{prefix}rejected": "boolean"}, start, keep)
