"""SentencePiece BPE encoding by backtracking, and its decoding.

The encoder finds the one token sequence that merging would give, left to right: an Aho-Corasick automaton lists the
tokens that start at each place, the longest is tried first, a token may follow another only if re-merging the two
leaves their border alone, and a bit field holds the places from which no compatible continuation exists.

Texts are cut before every run of U+2581 and around characters that are in no piece: no piece reaches over such a
place (asserted when a model is loaded), so the parts are encoded alone and kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import portions

SPACE = "▁"
#: Entries of each of a worker's three caches; at about 0.4 KB each this bounds them to some 120 MB.
CACHE_PARTS = 100_000


class PieceCodec:
    """encode() and decode() of one model file; equal to the library's for BPE models with byte fallback."""

    def __init__(self, model_path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bytes: dict[int, int] = {int(self.pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.unknown = sp.unk_id()
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        if sp.encode("a  béﬁ") != sp.encode("a  béﬁ", add_bos=False) or sp.decode(sp.encode("  a  ﬁ ")) != "  a  ﬁ ":
            raise ValueError("the model normalizes its input; only the identity is supported")
        self.ids = {self.pieces[i]: i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece reaches over a word's start")
        # Priority of the merge that makes a piece; pieces of one character come before any merge.
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        at = {s: n + 1 for n, s in enumerate(scores)}
        self.rank = {i: 0 if len(self.pieces[i]) == 1 else at[sp.get_score(i)] for i in plain}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.split: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in sorted(plain, key=lambda i: (len(self.pieces[i]), i)):
            p = self.pieces[i]
            if len(p) > 1:
                whole = self._merge(p)
                if whole is None or whole[0] != i:
                    continue  # merging never makes this piece
                self.split[i] = whole[1]
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        # The longest made piece that is a proper beginning of another, and lengths in characters.
        made = {p: i for i, p in enumerate(self.pieces) if i in self.split or p in self.chars and self.ids[p] == i}
        self.length = [len(p) for p in self.pieces]
        self.shorter = [-1] * size
        for p, i in made.items():
            self.shorter[i] = next((made[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in made), -1)
        self.compatible: dict[int, bool] = {}
        self.texts = [str(i) for i in range(size)]
        self.plain = [p.replace(SPACE, " ") for p in self.pieces]
        self.plain[self.unknown] = " ⁇ "
        self.cache: dict[str, tuple[str, str]] = {}
        self.recent: dict[str, tuple[str, str]] = {}
        self.known: dict[str, list[int]] = {}
        self._units = re.compile(f"{SPACE}+[^{SPACE}]*")
        # A border between two characters that stand side by side in no piece is safe too; cutting words off what
        # follows them makes for far fewer different parts.
        letters = {c for c in self.chars if c.isalpha()}
        glued = {b for p in self.ids for a, b in zip(p, p[1:]) if a in letters}
        inside, word, ends = (re.escape("".join(sorted(x))) for x in (self.chars - {SPACE}, letters, self.chars - glued - letters - {SPACE}))
        self._parts = re.compile(f"{SPACE}*[{word}]++(?=[{ends}])|{SPACE}+[{inside}]*|[{inside}]+|[^{inside}{SPACE}]")

    def _merge(self, text: str) -> tuple[int, tuple[int, int]] | None:
        """The piece that plain merging makes of the whole text, and its last merge; None if it ends in several pieces."""
        left = self._merged(text)
        return None if len(left) != 1 or self._last is None else (left[0], self._last)

    def _merged(self, text: str) -> list[int]:
        """Plain merging with a heap: best priority first, leftmost among equals."""
        ids, rank, pieces = self.ids, self.rank, self.pieces
        seq: list[int] = [ids[c] for c in text]
        after, before = list(range(1, len(seq) + 1)), list(range(-1, len(seq) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if a >= 0 and b < len(seq):
                made = ids.get(pieces[seq[a]] + pieces[seq[b]])
                if made is not None:
                    heapq.heappush(heap, (rank[made], a, seq[a], seq[b], made))

        for a in range(len(seq) - 1):
            offer(a)
        self._last = None
        while heap:
            _, a, x, y, made = heapq.heappop(heap)
            b = after[a]
            if seq[a] != x or b >= len(seq) or seq[b] != y:
                continue
            seq[a], seq[b] = made, -1
            after[a] = after[b]
            if after[b] < len(seq):
                before[after[b]] = a
            self._last = (x, y)
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [i for i in seq if i >= 0]

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b ends in just these two.

        Merges are undone from the latest on; the border is crossed if the tokens now beside it would have merged
        before one of the merges that are already undone (on equal priority, the one further left goes first).
        """
        x, y, pieces, ids, rank, split = a, b, self.pieces, self.ids, self.rank, self.split
        x_limit, y_limit = float("inf"), float("inf")  # priorities of the merges that take x or y away from the border
        fits = True
        while True:
            made = ids.get(pieces[x] + pieces[y])
            if made is not None and (r := rank[made]) < x_limit and r <= y_limit:
                fits = False
                break
            rx, ry = rank[x], rank[y]
            if rx == 0 and ry == 0:
                break
            if rx > ry or (rx == ry and rx):
                x_limit, x = rx, split[x][1]
            else:
                y_limit, y = ry, split[y][0]
            # x is there from its own merge until x_limit; before that only its parts are beside the border
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[a * len(self.pieces) + b] = fits
        return fits

    def _backtrack(self, text: str) -> list[int]:
        whole, ahead = len(text), self.automaton.iter_long
        length, shorter, known, size, may = self.length, self.shorter, self.compatible, len(self.pieces), self._may_follow
        longest = [-1] * whole  # -1: not looked up yet
        at = 0
        for end, (n, i) in ahead(text):
            longest[at] = i
            at = end + 1
        failed = bytearray(whole + 1)
        out: list[int] = []
        at, before, i = 0, -1, longest[0]
        while at < whole:
            while i >= 0:
                to = at + length[i]
                if not failed[to]:
                    if before < 0:
                        break
                    fits = known.get(before * size + i)
                    if may(before, i) if fits is None else fits:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at, before = to, i
                if at < whole and (i := longest[at]) < 0:
                    i = longest[at] = next(ahead(text, at))[1][1]
            else:
                failed[at] = 1
                i = out.pop()  # of at least one token, as every character is one
                at -= length[i]
                i, before = shorter[i], out[-1] if out else -1
        return out

    def encode_part(self, part: str) -> list[int]:
        if part[0] not in self.chars:
            return [self.bytes[b] for b in part.encode()]
        # Pieces of several U+2581 share one priority, for which a piece has no last merge of its own.
        return self._merged(part) if SPACE * 2 in part else self._backtrack(part)

    def parts(self, text: str) -> list[str]:
        return self._parts.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts(text) for i in self.encode_part(p)]

    def _decode_raw(self, ids: list[int]) -> str:
        plain, byte_of = self.plain, self.byte_of
        if ids[0] not in byte_of and byte_of.keys().isdisjoint(ids):
            return "".join([plain[i] for i in ids])
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                out.append(_utf8(run))
                run.clear()
            out.append(plain[i])
        return "".join(out) + (_utf8(run) if run else "")

    def decode(self, ids: list[int]) -> str:
        text = self._decode_raw(ids) if ids else ""
        return text[1:] if text.startswith(" ") else text

    def described(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the decoded text."""
        if not text:
            return 0, "", ""
        if "  " in text or SPACE in text or text[0] == " ":
            units = self._units.findall(SPACE + text.replace(" ", SPACE))
        else:
            units = text.split(" ")  # each stands for itself after one U+2581
            if not units[-1]:
                units[-1:] = [SPACE]
        cache = self.cache
        found = list(map(cache.get, units))
        if None in found:
            for at, pair in enumerate(found):
                if pair is None:
                    found[at] = self._described_unit(units[at])
        ids = ",".join([a for a, _ in found])
        decoded = "".join([b for _, b in found])
        return ids.count(",") + 1, ids, decoded[1:] if decoded.startswith(" ") else decoded

    def _described_unit(self, unit: str) -> tuple[str, str]:
        cache, recent, texts = self.cache, self.recent, self.texts
        if (pair := recent.get(unit)) is None:
            ids: list[int] = []
            for part in self._parts.findall(unit if unit[0] == SPACE else SPACE + unit):
                if (some := self.known.get(part)) is None:
                    some = self.encode_part(part)
                    if len(part) < 40:
                        if len(self.known) > CACHE_PARTS:
                            self.known.clear()
                        self.known[part] = some
                ids += some
            pair = ",".join([texts[i] for i in ids]), self._decode_raw(ids)
        # What comes again goes to the cache proper, so the many words that occur once do not drive out the others.
            if len(unit) < 40:
                if len(recent) > CACHE_PARTS:
                    recent.clear()
                recent[unit] = pair
        else:
            if len(cache) > CACHE_PARTS:
                cache.clear()
            cache[unit] = pair
        return pair


def _utf8(run: bytearray) -> str:
    """Each byte that starts no whole character becomes U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(run[at : at + n]).decode("utf-8"))
            except UnicodeDecodeError:
                continue
            at += n
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """One codec per worker and model file."""
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Token counts and digests of every whole text; with keep, also `ids` and `decoded` themselves.

    Output columns: id_col, n_tokens, ids_sha256, decoded_sha256 (and ids array<int>, decoded string with keep).
    A null text counts as empty: 0 tokens, the digests of the empty string. Null ids pass through; repeated rows each
    give a row; an empty table gives no rows; other columns are neither read nor clash, as only two columns are used.
    Each executor reads model_path, which is a file of the installed tokenizer package.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        # Ids of a portion's texts are held at once, so portions are small when they are kept.
        for batch in portions(batches, 1, *([1 << 20] if keep else [])):
            rows = ([], [], [], [], [])
            for text in batch.column(1).to_pylist():
                n, ids, decoded = own.described(text or "")
                rows[0].append(n)
                rows[1].append(hashlib.sha256(ids.encode()).hexdigest())
                rows[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep:
                    rows[3].append(np.fromstring(ids, np.int32, sep=",") if ids else np.empty(0, np.int32))
                    rows[4].append(decoded)
            out = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            if keep:
                out += [pa.array(rows[3], pa.list_(pa.int32())), pa.array(rows[4], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(encode, schema)
