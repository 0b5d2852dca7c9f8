"""BPE encoding and decoding with tree concatenation.

Short texts are encoded whole. A long text is cut into segments, and the
segments, as rows of their own, are encoded in parallel by all executors. A cut
is put where the pre-tokeniser splits anyway, so both sides are exact as they
are. Where no such place is near (one run of a character class longer than
``LOOK``), the cut falls inside one unsplit piece. Both halves are then encoded
on their own and joined pairwise, as a tree: a window of tokens around the join
is encoded again and grows until its first token is that of the left side and
its last that of the right side. Each pair of neighbours then stands in some
exact encoding, which for merge lists of this kind makes the whole exact; with
a window that covers both sides it is exact in any case.

Edge cases: null text is empty and has no tokens; repeated rows stay apart (a
row's place in its input is part of the key that puts segments together again);
special tokens in a text become their ids and are never cut; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits exactly as the byte-level pre-tokeniser does; possessive forms only save backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters before a wanted cut among which a natural boundary is looked for.
LOOK = 256
#: Texts of more characters are cut into segments of about as many.
SPLIT_CHARS = 32_768
_CLASS = regex.compile(r"(\p{L})|(\p{N})|(\s)")


def default_vocabulary() -> str:
    """Path of the public vocabulary; only its path is known here, it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in out.values():
            out[chr(extra)] = b
            extra += 1
    return out


class ByteBpe:
    """A byte-level BPE vocabulary (JSON of the tokenizers library) with exact joins."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {b: i for b, i in ranks.items() if i not in self.special.values()}
        self.bpe = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.pieces = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.size = max(ranks.values()) + 1 + len(self.special)

    def encode(self, text: str) -> np.ndarray:
        """Ids (uint32) of the whole text."""
        return self.bpe.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.bpe.decode_bytes(ids.tolist() if isinstance(ids, np.ndarray) else ids).decode("utf-8", errors="replace")

    def ends_sentence(self) -> np.ndarray:
        """For each id, whether its bytes end a sentence or a line."""
        out = np.zeros(self.size + 1, bool)
        for i in range(self.size):
            try:
                b = self.bpe.decode_single_token_bytes(i)
            except KeyError:
                continue
            out[i] = b.rstrip(b"\"')] ")[-1:] in (b".", b"!", b"?") or b"\n" in b
        return out

    def _piece(self, data: bytes) -> list[int]:
        return self.bpe._encode_single_piece(data)

    def _bytes(self, ids: list[int]) -> bytes:
        return self.bpe.decode_bytes(ids)

    # -- cutting ---------------------------------------------------------
    def _natural(self, text: str, at: int) -> bool:
        """Whether the pre-tokeniser always splits before text[at], whatever else the text holds."""
        a, b = _CLASS.match(text[at - 1]), _CLASS.match(text[at])
        ka, kb = (a.lastindex if a else 0), (b.lastindex if b else 0)
        if kb == 3:  # white space after something else; inside a run, before its last character if text follows
            # (a special token ends the stretch that is split, so the run before it stays whole)
            return ka != 3 or (at + 1 < len(text) and not text[at + 1].isspace() and not any(text.startswith(s, at + 1) for s in self.special))
        if ka == 3 or ka == kb:
            return False
        return ka in (1, 2) or kb == 2 or text[at - 1] != "'"

    def cuts(self, text: str, size: int) -> list[tuple[int, bool]]:
        """Places at which to cut, each with whether it falls inside an unsplit piece."""
        out: list[tuple[int, bool]] = []
        at, longest = size, max(map(len, self.special), default=0)
        while at < len(text):
            low = max(at - LOOK, out[-1][0] + 1 if out else 1)
            place = next((p for p in range(at, low - 1, -1) if self._natural(text, p)), None)
            inside = place is None
            place = at if inside else place
            if inside:
                while text[place] == "'" and text[place + 1 : place + 2] in tuple("stmdrvl") and place > low:
                    place -= 1
            for m in self.specials.finditer(text, max(0, place - longest), min(len(text), place + longest)):
                if m.start() < place < m.end():
                    place, inside = (m.start(), False) if m.start() > (out[-1][0] if out else 0) else (m.end(), False)
            if place >= len(text):
                break
            out.append((place, inside))
            at = place + size
        return out

    def segment(self, text: str, open_left: bool, open_right: bool) -> tuple[np.ndarray, int, int]:
        """Ids of a segment and how many of them belong to the unsplit piece at its open left and right end."""
        if not (open_left or open_right):
            return self.encode(text), 0, 0
        marks = list(self.specials.finditer(text))
        begin = marks[-1].end() if marks else 0
        end = marks[0].start() if marks else len(text)
        left = next(self.pieces.finditer(text, 0, end), None) if open_left else None
        right = None
        if open_right:
            for right in self.pieces.finditer(text, begin):  # noqa: B007  the last one
                pass
        if left is not None and right is not None and left.span() == right.span():
            ids = self._piece(text.encode())
            return np.array(ids, np.uint32), len(ids), len(ids)
        a = left.end() if left else 0
        b = right.start() if right else len(text)
        first = self._piece(text[:a].encode()) if left else []
        last = self._piece(text[b:].encode()) if right else []
        return np.concatenate([np.array(first, np.uint32), self.encode(text[a:b]), np.array(last, np.uint32)]), len(first), len(last)

    # -- joining ---------------------------------------------------------
    def join_piece(self, left: list[int], right: list[int], window: int = 4) -> list[int]:
        """Encoding of one unsplit piece from those of its two parts."""
        w = window
        while True:
            a, b = left[-w:], right[:w]
            new = self._piece(self._bytes(a) + self._bytes(b))
            if (w >= len(left) or new[0] == a[0]) and (w >= len(right) or new[-1] == b[-1]):
                return left[: max(0, len(left) - w)] + new + right[w:]
            w *= 2

    def join(self, left: tuple, right: tuple) -> tuple:
        """Two neighbours (ids, n_left, n_right, open_left, open_right) as one."""
        ids, n_left, n_right, open_left, open_right = left
        more, m_left, m_right, more_open, m_open = right
        if not more_open:
            return np.concatenate([ids, more]), n_left, m_right, open_left, m_open
        keep = len(ids) - n_right
        both = self.join_piece(ids[keep:].tolist(), more[:m_left].tolist())
        out = np.concatenate([ids[:keep], np.array(both, np.uint32), more[m_left:]])
        n_left = len(both) if open_left and n_left == len(ids) else n_left
        m_right = len(both) if m_open and m_right == len(more) else m_right
        if len(out) == len(both):
            n_left, m_right = (len(both) if open_left else 0), (len(both) if m_open else 0)
        return out, n_left, m_right, open_left, m_open

    def join_all(self, parts: list[tuple]) -> np.ndarray:
        """Join neighbours pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][0] if parts else np.empty(0, np.uint32)

    def encode_split(self, text: str, size: int) -> np.ndarray:
        """Ids of a text by way of segments; equal to ``encode``."""
        cuts = self.cuts(text, size)
        edges = [(0, False), *cuts, (len(text), False)]
        return self.join_all([(*self.segment(text[a:b], oa, ob), oa, ob) for (a, oa), (b, ob) in zip(edges, edges[1:], strict=False)])


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One copy of a vocabulary for each Python worker."""
    return ByteBpe(path)


def _digest_batch(bpe: ByteBpe, ids: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([x.astype("<u4", copy=False).tobytes() for x in ids], pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())]


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """Encode every text and decode its ids again.

    Columns: doc_id, ids (binary: little-endian unsigned 32-bit), decoded.
    Texts of up to ``split_chars`` characters take one pass without a shuffle;
    only longer ones are dealt out in segments and joined by row.
    """
    path = path or default_vocabulary()
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *_digest_batch(bpe, ids)], ["doc_id", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for row in range(batch.num_rows):
                rid, doc, text = (batch.column(i)[row].as_py() for i in range(3))
                edges = [(0, False), *bpe.cuts(text, split_chars), (len(text), False)]
                pairs = list(zip(edges, edges[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid] * len(pairs), pa.int64()), pa.array([doc] * len(pairs), pa.int64()), pa.array(range(len(pairs)), pa.int32()), pa.array([text[a:b] for (a, _), (b, _) in pairs], pa.string()), pa.array([o for (_, o), _ in pairs], pa.bool_()), pa.array([o for _, (_, o) in pairs], pa.bool_())],
                    ["rid", "doc_id", "seq", "part", "open_left", "open_right"],
                )

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = batch.to_pylist()
            got = [bpe.segment(r["part"], r["open_left"], r["open_right"]) for r in rows]
            cols = [batch.column(i) for i in (0, 1, 2, 4, 5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0].tobytes() for x in got], pa.binary()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], ["rid", "doc_id", "seq", "open_left", "open_right", "ids", "n_left", "n_right"])

    def joined(table):
        bpe = load(path)
        rows = table.sort_by("seq").to_pylist()
        ids = bpe.join_all([(np.frombuffer(r["ids"], np.uint32), r["n_left"], r["n_right"], r["open_left"], r["open_right"]) for r in rows])
        return pa.Table.from_arrays([pa.array([rows[0]["doc_id"]], pa.int64()), *_digest_batch(bpe, [ids])], ["doc_id", "ids", "decoded"])

    out = "doc_id long, ids binary, decoded string"
    short = src.where(F.length("text") <= split_chars).mapInArrow(whole, out)
    long = (
        src.withColumn("rid", F.monotonically_increasing_id())
        .where(F.length("text") > split_chars)
        .select("rid", "doc_id", "text")
        .mapInArrow(cut, "rid long, doc_id long, seq int, part string, open_left boolean, open_right boolean")
        .repartition("rid", "seq")
        .mapInArrow(halves, "rid long, doc_id long, seq int, open_left boolean, open_right boolean, ids binary, n_left long, n_right long")
        .groupBy("rid")
        .applyInArrow(joined, out)
    )
    return short.unionByName(long)
