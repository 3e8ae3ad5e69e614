"""Language identification by compression with one raw-content dictionary per language."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.storage import read_table, save

#: Bytes of a dictionary, and of all of them; characters that one training text gives at most; compression level.
DICTIONARY, ALL_DICTIONARIES, PIECE, LEVEL = 256 * 1024, 1 << 28, 1000, 5
#: Training texts that are drawn per language on average; all if there are fewer.
DRAWN = 600
#: Languages whose dictionaries a worker holds at a time; more are compared in several passes.
GROUP = 64
#: Bytes that are compressed at once: each piece starts from the dictionary, so a long text is judged like its parts.
COMPRESSED = 1 << 16
#: Bytes other than ASCII letters and parts of longer characters become blanks.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def fold(column: str) -> Column:
    """crc32(column as text) mod 4; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4


def bare(text: str) -> bytes:
    """Lower-case words with single blanks between them; digits and signs dropped."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split())


def learn(labelled: DataFrame) -> list[list[tuple[str, bytes]]]:
    """Dictionaries from ``labelled(doc_id, text, lang)``, GROUP languages in a list, the most frequent language first.

    They are fitted on a bounded sample: about DRAWN texts a language, drawn by
    a hash of doc_id, PIECE characters from the middle of each, DICTIONARY
    bytes in all. Only this sample comes to the driver, for one list at a time.
    Dictionaries of many languages are shorter, so that all have
    ALL_DICTIONARIES bytes at most.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    most = min(DICTIONARY, ALL_DICTIONARIES // max(1, len(counts)))
    draw = F.xxhash64(F.lit("draw"), "doc_id") / F.lit(2.0**64) + 0.5
    start = F.greatest(F.lit(1), ((F.length("text") - PIECE) / 2).cast("int"))
    out = []
    for at in range(0, len(counts), GROUP):
        group = counts[at : at + GROUP]
        rate = F.create_map(*[F.lit(x) for r in group for x in (r["lang"], min(1.0, DRAWN / r["count"]))])[F.col("lang")]
        drawn = labelled.where(draw < rate).select("lang", draw.alias("draw"), "doc_id", F.substring("text", start, F.lit(PIECE)).alias("piece"))
        texts: dict[str, list[bytes]] = {r["lang"]: [] for r in group}
        for r in sorted(drawn.collect(), key=lambda r: (r["draw"], r["doc_id"] is None, r["doc_id"] or 0, r["piece"])):
            texts[r["lang"]].append(bare(r["piece"]))
        out.append([(lang, b" ".join(texts[lang])[:most]) for lang in texts])
    return out


@lru_cache(maxsize=1)  # a worker that is used again lets go of the models of the table before
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list:
    import zstandard

    out = []
    for lang, content in model:
        if len(content) < 8:  # too short for a dictionary
            out.append((lang, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)))
            continue
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def _compress(docs: DataFrame, group: list[tuple[str, bytes]], state: str) -> DataFrame:
    """Compare the languages of ``group`` with the best so far: ``state`` is struct(lang, size, second)."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(group))
    schema = docs.schema

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}").search
        compressors = _compressors(shared.value)
        for batch in batches:
            at, found = batch.schema.get_field_index(state), []
            for text, so_far in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column(at).to_pylist(), strict=True):
                text = "" if text is None else text.decode("utf-8", "replace")
                if not letter(text):
                    found.append(None)
                    continue
                data = bare(text) or text.encode()
                pieces = [data[k : k + COMPRESSED] for k in range(0, len(data), COMPRESSED)]
                sizes = [(sum(len(c.compress(p)) for p in pieces), lang) for lang, c in compressors]
                if so_far is not None:
                    sizes = [(so_far["size"], so_far["lang"]), *([(so_far["second"], "")] if so_far["second"] is not None else []), *sizes]
                sizes.sort(key=lambda x: x[0])  # of equal sizes the first language stays first
                found.append({"lang": sizes[0][1], "size": sizes[0][0], "second": sizes[1][0] if len(sizes) > 1 else None})
            yield batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, models: list[list[tuple[str, bytes]]], least_margin: float, name: str) -> DataFrame:
    """All columns of ``docs(text, ..)`` and a struct ``name`` of lang_pred, score and rejected. Edge cases as in ``predict``."""
    state = F.lit(None).cast("struct<lang: string, size: bigint, second: bigint>")
    docs = docs.withColumn(name, state)
    for k, group in enumerate(models):
        docs = _compress(save(docs) if k else docs, group, name)
    lang, size, second = (F.col(f"{name}.{c}") for c in ("lang", "size", "second"))
    score = F.when(lang.isNull(), 0.0).when(second.isNull(), 1.0).otherwise((second - size) / second)
    found = F.struct(F.coalesce(lang, F.lit("und")).alias("lang_pred"), score.alias("score"), (lang.isNull() | (score < least_margin)).alias("rejected"))
    return docs.withColumn(name, found)


def predict(docs: DataFrame, models: list[list[tuple[str, bytes]]], least_margin: float = 0.0) -> DataFrame:
    """The language whose dictionary leaves each whole text smallest.

    Returns doc_id, lang_pred, score, rejected. score is the share that the
    best language saves over the second (1 if only one is known). A null text
    or one without a letter is ``und`` with score 0. rejected is true for
    these and wherever the score is under ``least_margin``. Ties go to the
    language with more training texts. A long text is compressed in pieces of
    COMPRESSED bytes and the sums are compared, so length doesn't narrow its
    margin; one task holds it whole. Rows are independent: repeated rows and
    null ids come back as they are; an empty table gives an empty result;
    without any labelled text all is ``und``; other columns are ignored.
    """
    found = judge(docs.select("doc_id", "text"), models, least_margin, "found")
    return found.select("doc_id", "found.lang_pred", "found.score", "found.rejected")


def learn_outside(docs: DataFrame) -> list[list[tuple[str, bytes]]]:
    """Learn from the rows of ``docs`` outside fold 2."""
    return learn(docs.where(fold("doc_id") != 2))


def identify(docs: DataFrame, least_margin: float = 0.0) -> DataFrame:
    """Learn from the rows of ``docs`` outside fold 2 and predict all rows. Edge cases as in ``predict``."""
    return predict(docs, learn_outside(docs), least_margin).withColumn("held_out", fold("doc_id") == 2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
