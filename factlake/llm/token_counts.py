"""Token counts that follow edits: a segment tree over each document's pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.byte_bpe import VOCABULARY, Memory, groups_of, tokenizer
from factlake.llm.storage import read_table, text_or_empty

#: Pre-tokens of a leaf when a tree is built.
LEAF = 64
#: Characters right of a pre-token that its end may depend on ("'re" looks two ahead, a blank run one).
LOOK_AHEAD = 4
#: Distinct pre-tokens whose counts a worker remembers; a count takes no memory beside the text of its pre-token.
COUNTED = 400_000

_counters: dict = {}


class Counter(Memory):
    """Tokens of single pre-tokens, remembered by the worker."""

    def __init__(self, data: bytes, pattern: str):
        super().__init__(COUNTED)
        self.bpe = tokenizer(data, pattern)
        self.pattern = self.bpe.pattern

    def fresh(self, pieces: list[str]) -> list[int]:
        return [len(ids) // 4 for ids in self.bpe.fresh(pieces)]

    def count(self, pieces: list[str]) -> list[int]:
        return self.remembered(pieces)


class PretokenTree:
    """Lengths and token counts of pre-tokens in leaves, with their sums in the nodes above.

    ``nodes`` is a heap: node i has the children 2i and 2i + 1 and holds
    [characters, tokens, pre-tokens] of all leaves below it.
    """

    def __init__(self, text: str, counter: Counter, pieces: list[str] | None = None):
        self.text, self.counter, self.encoded = text, counter, 0
        pieces = counter.pattern.findall(text) if pieces is None else pieces
        self._build(list(map(len, pieces)), counter.count(pieces))

    def _build(self, sizes: list[int], counts: list[int]) -> None:
        n = max(1, -(-len(sizes) // LEAF))
        self.base = 1 << (n - 1).bit_length()
        self.leaves = [(sizes[k * LEAF : (k + 1) * LEAF], counts[k * LEAF : (k + 1) * LEAF]) for k in range(self.base)]
        self.nodes = [[0, 0, 0] for _ in range(self.base)] + [[sum(s), sum(c), len(s)] for s, c in self.leaves]
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.nodes[i] = [a + b for a, b in zip(self.nodes[2 * i], self.nodes[2 * i + 1], strict=True)]

    @property
    def tokens(self) -> int:
        return self.nodes[1][1]

    def _find(self, place: int) -> tuple[int, int, int]:
        """(leaf, index in it, start) of the pre-token that holds character ``place``."""
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if place - start >= self.nodes[i][0]:
                start += self.nodes[i][0]
                i += 1
        sizes = self.leaves[i - self.base][0]
        for k, size in enumerate(sizes):
            if place - start < size:
                return i - self.base, k, start
            start += size
        return i - self.base, len(sizes), start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end; encode only what that can change."""
        old = self.text
        start = max(0, min(start, len(old)))
        end = max(start, min(end, len(old)))
        self.text = text = old[:start] + new + old[end:]
        shift = len(text) - len(old)
        safe = start
        while safe > 0 and old[safe - 1].isspace():
            safe -= 1
        leaf, k, at = self._find(max(0, safe - LOOK_AHEAD))
        if at > safe - LOOK_AHEAD:
            leaf, k, at = 0, 0, 0
        first = (leaf, k)
        # Old boundaries from here on, met one by one as new ones are found.
        to_leaf, to_k, old_at = leaf, k, at
        pieces, met = [], False
        for match in self.counter.pattern.finditer(text, at):
            new_at = match.start()
            while old_at + shift < new_at and to_leaf < self.base:
                if to_k < len(self.leaves[to_leaf][0]):
                    old_at += self.leaves[to_leaf][0][to_k]
                    to_k += 1
                else:
                    to_leaf, to_k = to_leaf + 1, 0
            if old_at >= end and old_at + shift == new_at:
                met = True
                break
            pieces.append(match.group())
        if not met or to_leaf == self.base:
            to_leaf, to_k = self.base - 1, len(self.leaves[-1][0])
        self.encoded += len(pieces)
        sizes, counts = [len(p) for p in pieces], self.counter.count(pieces)
        left, right = self.leaves[first[0]], self.leaves[to_leaf]
        tail = (right[0][to_k:], right[1][to_k:])
        self.leaves[first[0]] = (left[0][: first[1]] + sizes, left[1][: first[1]] + counts)
        if to_leaf == first[0]:
            self.leaves[to_leaf] = tuple(a + b for a, b in zip(self.leaves[to_leaf], tail, strict=True))
        else:
            for k in range(first[0] + 1, to_leaf):
                self.leaves[k] = ([], [])
            self.leaves[to_leaf] = tail
        if len(self.leaves[first[0]][0]) > 8 * LEAF:  # grown too large: build anew from the known counts
            self._build([x for s, _ in self.leaves for x in s], [x for _, c in self.leaves for x in c])
            return
        changed = set()
        for k in range(first[0], to_leaf + 1):
            s, c = self.leaves[k]
            self.nodes[self.base + k] = [sum(s), sum(c), len(s)]
            changed.add((self.base + k) // 2)
        while changed and 0 not in changed:
            for i in changed:
                self._sum(i)
            changed = {i // 2 for i in changed if i > 1}


def trees(texts: list[str], counter: Counter) -> Iterator[PretokenTree]:
    """The tree of each text; new pre-tokens of some texts are counted at once."""
    for group in groups_of(texts):
        listed = [counter.pattern.findall(text) for text in group]
        if len(group) > 1:
            counter.learn(list(chain.from_iterable(listed)))
        for text, pieces in zip(group, listed, strict=True):
            yield PretokenTree(text, counter, pieces)


#: A mail address: tried at the start of a run only and never given back, so that a long run is read once.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+"
EDIT = "array<struct<start:int,stop:int,replacement:string>>"


def count_edited(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Token counts before and after ``docs(doc_id, text, edits)``.

    ``edits`` are applied in order; start and stop count code points of the
    text as the edits before left it, and are clipped to it. Returns doc_id,
    n_tokens, n_edits, n_tokens_edited, n_pretokens and n_reencoded (pre-tokens
    that the edits made it encode again). A null text counts as empty, null
    edits as none, a null edit is skipped, a null replacement deletes. Repeated
    rows and null ids are rows like others; an empty table gives an empty
    result; other columns are ignored. One task holds one text at a time whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast((open(vocabulary, "rb").read(), pattern))
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_reencoded"]

    def run(batches):
        if shared.value not in _counters:
            _counters.clear()
            _counters[shared.value] = Counter(*shared.value)
        counter = _counters[shared.value]
        for batch in batches:
            rows = []
            texts = ["" if text is None else text.decode("utf-8", "replace") for text in batch.column(1).cast(pa.large_binary()).to_pylist()]
            for tree, edits in zip(trees(texts, counter), batch.column(2).to_pylist(), strict=True):
                before, pieces, done = tree.tokens, tree.nodes[1][2], 0
                for e in edits or []:
                    if e is not None and e["start"] is not None and e["stop"] is not None:
                        tree.edit(e["start"], e["stop"], e["replacement"] or "")
                        done += 1
                rows.append((before, done, tree.tokens, pieces, tree.encoded))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select("doc_id", "text", "edits").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Join ``edits(doc_id, seq, start, stop, replacement)`` to their documents, in the order of seq."""
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "replacement"))).alias("edits"))
    listed = listed.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].cast("int").alias("start"), e["stop"].cast("int").alias("stop"), e["replacement"].alias("replacement"))))
    return docs.select("doc_id", "text").join(listed, "doc_id", "left")


def with_redactions(docs: DataFrame) -> DataFrame:
    """doc_id, text and three edits of each text: its first mail address and its
    first run of six digits or more are masked, and a line with its source is
    added at the end. Patterns are linear in the text, whatever it holds."""

    def edit(start: Column | str, length: Column | str, new: Column) -> Column:
        start = F.col(start) if isinstance(start, str) else start
        return F.struct(start.cast("int").alias("start"), (start + length).cast("int").alias("stop"), new.alias("replacement"))

    docs = docs.select("doc_id", "text", text_or_empty().alias("body"), F.coalesce("source", F.lit("unknown")).alias("source"))
    for k, (pattern, new) in enumerate(((MAIL, "<mail>"), ("[0-9]{6,}", "<number>"))):
        docs = docs.withColumn("found", F.regexp_extract("body", pattern, 0)).withColumn("n", F.length("found")).withColumn("at", F.instr("body", F.col("found")) - 1)
        rest = F.substring("body", F.col("at") + F.col("n") + 1, F.length("body"))
        docs = docs.withColumn(f"edit{k}", F.when(F.col("n") > 0, edit("at", F.col("n"), F.lit(new))))
        docs = docs.withColumn("body", F.when(F.col("n") > 0, F.concat(F.substring("body", F.lit(1), F.col("at")), F.lit(new), rest)).otherwise(F.col("body")))
    last = edit(F.length("body"), F.lit(0), F.concat(F.lit("\nSource: "), F.col("source")))
    return docs.select("doc_id", "text", F.array("edit0", "edit1", last).cast(EDIT).alias("edits"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(with_redactions(read_table(spark, sf_dir, "documents")))
