"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factlake.llm.storage import read_table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Distinct pieces whose ids a worker remembers.
REMEMBERED = 100_000
#: Bytes of the pieces that are encoded at once; bytes of a piece above which it is merged by rank unseen.
PART, SHORT = 1 << 19, 4096
#: Pieces up to which a call merges all by rank; bytes of a piece up to which that goes without a heap.
FEW_PIECES, FEW_BYTES = 16, 64
#: Characters of the texts whose pieces are learned together.
GROUP = 1 << 18
#: Characters of a text whose pieces are listed at once.
LONG = 1 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The rank file's lines: base64 of a token's bytes, and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else one from 256 up."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return [table[b] for b in range(256)]


class Memory:
    """What ``fresh`` gives for single pieces, remembered in two generations.

    When ``known`` is half of ``most``, it becomes ``old``, and the old one goes;
    what is asked for again moves back. So frequent pieces stay, and no more than
    ``most`` are held beside those of one call.
    """

    def __init__(self, most: int):
        self.most = most
        self.known: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def fresh(self, pieces: list[str]) -> list:
        raise NotImplementedError

    def learn(self, pieces: list[str]) -> None:
        """Have all the pieces in ``known``."""
        new = {p for p in pieces if p not in self.known}
        if len(self.known) + len(new) > self.most // 2:
            self.old, self.known = self.known if len(self.known) <= self.most else {}, {}
            new = set(pieces)
        again = {p: self.old[p] for p in new if p in self.old}
        new = [p for p in new if p not in again]
        found = self.fresh(new)
        self.known.update(again)
        self.known.update(zip(new, found, strict=True))

    def remembered(self, pieces: list[str]) -> list:
        try:
            return list(map(self.known.__getitem__, pieces))
        except KeyError:
            self.learn(pieces)
            return list(map(self.known.__getitem__, pieces))


def parts_of(raws: list[bytes]) -> Iterator[list[bytes]]:
    """The byte strings in parts of about PART bytes."""
    part, size = [], 0
    for raw in raws:
        part.append(raw)
        size += len(raw)
        if size >= PART:
            yield part
            part, size = [], 0
    if part:
        yield part


def groups_of(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in groups of GROUP characters at most, or of one text."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > GROUP:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def hold_twice(raws: list[bytes]) -> np.ndarray:
    """Which of the byte strings hold some three bytes twice."""
    who = np.repeat(np.arange(len(raws), dtype=np.uint64), np.fromiter(map(len, raws), np.int64, len(raws)))
    data = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64)
    out = np.zeros(len(raws), bool)
    if len(data) > 2:
        codes = who[2:] << np.uint64(24) | data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
        codes = np.sort(codes[who[:-2] == who[2:]])
        out[(codes[1:][codes[1:] == codes[:-1]] >> np.uint64(24)).astype(np.int64)] = True
    return out


class ByteBpe(Memory):
    """One vocabulary: encodes the pieces of a text with the tokenizers library.

    The library merges listed pairs only, while a rank file allows any pair
    whose bytes together are a token; so every such pair is listed, in the
    order of the token's rank. The list can't say which of two different pairs
    of one token is further left. Two such pairs only meet in a piece that
    holds the token twice, and the token has three bytes or more, or there
    were no two ways to cut it. So wherever no three bytes of a piece occur
    twice the library's ids are those of the ranks; only the other pieces are
    merged by rank here, and pieces of more than SHORT bytes or those of a
    small call, whatever they hold. ``n_by_rank`` counts them. The others go through the library many at
    a time, as lines of one text in which a line feed is a token of its own.
    """

    def __init__(self, data: bytes, pattern: str):
        super().__init__(REMEMBERED)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.ranks = ranks = read_ranks(data)
        chars = byte_characters()
        self.shown = {b: c for b, c in enumerate(chars)}
        shown = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            for cut in range(1, len(token)):
                if token[:cut] in ranks and token[cut:] in ranks:
                    merges.append((shown[token[:cut]], shown[token[cut:]]))
        # No byte is shown as a line feed.
        self.line_end = max(ranks.values()) + 1
        # A piece that is a token as a whole is that token, whatever the merges give.
        vocabulary = {"\n": self.line_end, **{shown[t]: r for t, r in ranks.items()}}
        self.library = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
        self.pattern = regex.compile(pattern)
        back = {c: b for b, c in enumerate(chars)}
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = bytes(back[c] for c in shown[token])
        self.token_length = np.array([len(t) for t in self.token_bytes])
        self.n_by_rank = 0

    def merge_by_rank(self, piece: bytes) -> list[int]:
        """Merge the neighbours that give the token of the lowest rank, the leftmost first, until there are none."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) <= FEW_BYTES:
            return self._merge_few(piece)
        ranks, n = self.ranks, len(piece)
        after, before = array("q", range(1, n + 2)), array("q", range(-1, n))  # of the part that starts here
        gone = bytearray(n + 1)  # starts no part any more

        def pair(at: int) -> int | None:
            """The rank of what the part at ``at`` and the next one give."""
            return ranks.get(piece[at : after[after[at]]]) if after[at] < n else None

        waiting = [rank << 40 | at for at in range(n - 1) if (rank := pair(at)) is not None]
        heapq.heapify(waiting)
        while waiting:
            entry = heapq.heappop(waiting)
            at = entry & ((1 << 40) - 1)
            if gone[at] or pair(at) != entry >> 40:  # merged since
                continue
            cut = after[at]
            after[at], gone[cut] = after[cut], 1
            if after[at] < n:
                before[after[at]] = at
            for start in (at, before[at]):
                if start >= 0 and (rank := pair(start)) is not None:
                    heapq.heappush(waiting, rank << 40 | start)
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def _merge_few(self, piece: bytes) -> list[int]:
        """``merge_by_rank`` without a heap, faster for a few bytes."""
        rank, none = self.ranks.get, len(self.token_bytes)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < none:
            at = pairs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
        return [self.ranks[part] for part in parts]

    def fresh(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out = []
        for raws in parts_of([p.encode("utf-8", "replace") for p in pieces]):
            alone = [k for k, raw in enumerate(raws) if 0 < len(raw) <= SHORT] if len(raws) > FEW_PIECES else []
            alone = [k for k, twice in zip(alone, hold_twice([raws[k] for k in alone]), strict=True) if not twice]
            found = dict(zip(alone, self._in_lines([raws[k] for k in alone]), strict=True))
            self.n_by_rank += len(raws) - len(found)
            out += [found[k] if k in found else np.asarray(self.merge_by_rank(raw), "<u4").tobytes() for k, raw in enumerate(raws)]
        return out

    def _in_lines(self, raws: list[bytes]) -> list[bytes]:
        """The library's ids of each byte string."""
        if not raws:
            return []
        text = "\n".join([raw.decode("latin-1").translate(self.shown) for raw in raws])
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.append(np.flatnonzero(ids == self.line_end), len(ids))).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern; those of a long text come some at a time."""
        if len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        matches = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(matches, LONG // 4)):
            yield part

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(b"".join(self.remembered(part)) for part in self.pieces(text))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """``encode`` of each text; new pieces of some texts are learned at once."""
        for group in groups_of(texts):
            if len(group[0]) > LONG:
                yield self.encode(group[0])
                continue
            listed = [self.pattern.findall(text) for text in group]
            self.learn(list(chain.from_iterable(listed)))
            for pieces in listed:
                yield b"".join(self.remembered(pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def n_split(self, ids: np.ndarray, decoded: bytes) -> int:
        """How many tokens start or end within a character."""
        inner = np.append((np.frombuffer(decoded, np.uint8) & 0xC0) == 0x80, False)
        ends = np.cumsum(self.token_length[ids])
        return int((inner[ends - self.token_length[ids]] | inner[ends]).sum()) if len(ids) else 0

    def offsets(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """Code-point start and end of each token; a token that holds part of a
        character spans that whole character."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        ends = np.cumsum(self.token_length[np.array(ids, int)]).astype(int)
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        starts = np.concatenate([[0], ends[:-1]]).astype(int) if len(ids) else ends
        first = np.minimum(leads[np.minimum(starts + 1, len(data))] - 1, leads[-1])
        return first.tolist(), leads[ends].tolist()


@lru_cache(maxsize=2)
def tokenizer(data: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(data, pattern)


def decode_stream(token_bytes: list[bytes], ids: Iterator[int]) -> Iterator[str]:
    """Decode ids one at a time; bytes of a split character wait until it is whole."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        yield decoder.decode(token_bytes[i])
    yield decoder.decode(b"", True)


def _texts(column: pa.Array) -> list[str]:
    return ["" if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.large_binary()).to_pylist()]


def encode_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, offsets: bool = False
) -> DataFrame:
    """Encode and decode every whole text.

    Returns doc_id, ids (array of int), decoded (binary) and, if asked for,
    token_start and token_end in code points. A null text counts as empty and
    has no ids. Rows are independent: repeated rows and ids are returned as
    they come, null ids too; an empty table gives an empty result; other
    columns are ignored. A text is held whole by one task, which lists its
    pieces some at a time; a single piece of n bytes (a run of letters, say)
    takes some 60 n bytes while it is merged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())
    schema = "doc_id long, ids array<int>, decoded binary" + ", token_start array<int>, token_end array<int>" * offsets

    names = [c.split()[0] for c in schema.split(", ")]

    def lists(values: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *values]).astype(np.int32)))

    def run(batches):
        bpe = tokenizer(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [np.frombuffer(ids, "<i4") for ids in bpe.encode_all(_texts(part.column(1)))]
                plain = [f.tolist() for f in found]
                columns = [part.column(0), lists(found), pa.array(map(bpe.decode, plain), pa.binary())]
                if offsets:
                    spans = [bpe.offsets(ids) for ids in plain]
                    columns += [lists([np.array(s[k], np.int32) for s in spans]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """As ``encode_documents``, but with digests of the ids and of the decoded bytes.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 and n_split_tokens (tokens whose offsets
    start or end within a character). The ids never leave the worker, so the
    result stays a few dozen bytes a document. Edge cases as there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches):
        bpe = tokenizer(shared.value, pattern)
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for ids in bpe.encode_all(_texts(batch.column(1))):
                numbers = np.frombuffer(ids, "<u4")
                decoded = bpe.decode(numbers.tolist())
                rows.append((len(numbers), sha(ids).hexdigest(), sha(decoded).hexdigest(), bpe.n_split(numbers, decoded)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split_tokens long")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read_table(spark, sf_dir, "documents"))
