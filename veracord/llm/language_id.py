"""Language identification by compression.

Each language gets a zstandard raw-content dictionary made of labelled text. A text
is lower-cased, all but its letters becomes single spaces, and it is cut into blocks;
every block is compressed once with each dictionary, and the language whose dictionary
leaves the fewest bytes over the whole text wins. Blocks keep the dictionary in reach
all along a long text. Where the gap to the runner-up, as a share of its bytes, is
below ``margin``, the result is rejected.

Training takes a bounded sample: of each language the ``sample_docs`` labelled
texts with the smallest keyed hash of doc_id, of each an excerpt of at most
``dict_bytes // sample_docs`` bytes at a keyed place of the whole text. Prediction reads
whole texts, and never language, source or id.

Scale: training ranks (language, hash) pairs in ``SPREAD`` parts of each language, then
the first of each part, and broadcasts the chosen pairs to fetch their texts; prediction
is one pass without a shuffle. What is sent to the
workers is bounded by ``dict_bytes`` times the number of languages, and languages
are limited to ``max_languages`` (an error beyond, never a silent cut).

Defined results: null texts and texts without a letter give ``und`` with score 0;
equal sizes go to the alphabetically first language; without training rows all is
``und``. Repeated rows are predicted each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracord.llm.common import cut

UNDETERMINED = "und"
#: Parts in which a language's documents are ranked.
SPREAD = 64
HAS_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """The pattern also meets numerals such as U+00B2, so its hits are looked at again."""
    return any(m.group().isalpha() for m in HAS_LETTER.finditer(text))


NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str) -> bytes:
    """What is compressed: lower-cased letters, with one space for everything between them."""
    return NOT_LETTERS.sub(" ", text.lower()).encode()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(labelled: DataFrame, sample_docs: int = 64, dict_bytes: int = 49152, max_languages: int = 300) -> dict[str, bytes]:
    """Dictionaries by language from ``labelled(doc_id, text, lang)``."""
    keyed = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("at", F.xxhash64(F.lit("dictionary"), "doc_id"))
    # the k smallest hashes of each language, first within SPREAD parts of it, so that no language meets in one task
    part = F.pmod(F.xxhash64("at"), F.lit(SPREAD)).alias("part")
    least = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).where(F.col("n") <= sample_docs).drop("n")
    few = cut(least(least(keyed.select("lang", "at", part).distinct(), "lang", "part").drop("part"), "lang"), "sample")
    if few.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    size = dict_bytes // sample_docs
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.length("text") - size, F.lit(0)) + 1) + 1
    excerpt = F.encode(F.substr("text", place.cast("int"), F.lit(size)), "UTF-8")
    chosen = keyed.join(F.broadcast(few), ["lang", "at"])  # at most sample_docs rows for each of max_languages
    got = chosen.select("lang", "at", excerpt.alias("text")).orderBy("lang", "at", "text").select("lang", "text").toLocalIterator()
    parts: dict[str, list[bytes]] = {}
    for lang, text in got:
        parts.setdefault(lang, []).append(bytes(text)[:size])
    return {lang: normalised(b" ".join(x).decode("utf-8", "ignore"))[-dict_bytes:] for lang, x in sorted(parts.items())}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], block: int = 1024, level: int = 6, margin: float = 0.02, reject_as_undetermined: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every whole text.

    ``score`` is the gap to the runner-up, relative and squashed to 0..1 (``margin``
    lies at 0.5). Rejected texts become ``und`` unless ``reject_as_undetermined`` is off.
    """
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        langs, codecs = list(model.value), []
        for data in model.value.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            codecs.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if not text or not langs or not has_letter(text):
                    out.append((UNDETERMINED, 0.0, True))
                    continue
                raw = normalised(text)
                pieces = [raw[i : i + block] for i in range(0, len(raw), block)]
                sizes = sorted((sum(len(c(p)) for p in pieces), lang) for c, lang in zip(codecs, langs, strict=True))
                gap = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
                no = gap < margin
                out.append((UNDETERMINED if no and reject_as_undetermined else sizes[0][1], gap / (gap + margin) if gap else 0.0, no))
            lang, score, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op5(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose fold is not held out; predict all, with the rejection as a column."""
    fold = held_out(F.col("doc_id"))
    dictionaries = train(docs.where(~F.coalesce(fold, F.lit(True))))
    out = predict(docs, dictionaries, reject_as_undetermined=False)
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "rejected")
