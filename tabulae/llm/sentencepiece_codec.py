"""Operator 2: SentencePiece merge-type encoding by backtracking, and decoding.

A text is cut into units at the places that no piece crosses (before a run of word
markers, around characters outside the alphabet). A unit is encoded without a merge loop:
an Aho-Corasick automaton lists the pieces that match at each position; the longest is
tried first; a piece may follow its predecessor only if re-merging the two would leave
their border in place; positions from which no encoding exists are cleared in a bitfield,
so none is tried twice. Encoded units are kept in a bounded table for each worker.

Null texts count as empty; an empty text has no ids and decodes to the empty string.
Repeated rows are encoded each on its own, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tabulae.llm.common import arrow_map, only

MARK = "▁"
#: Encoded units kept in one worker before the table is emptied.
CACHE_UNITS = 800_000
#: Up to this length the bitfield of failed positions is one whole number.
LONG = 512


class MergeEncoder:
    """Encodes and decodes as the library does for a BPE model with the identity
    normaliser, a dummy prefix and byte fallback; other models are refused."""

    def __init__(self, model_path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if sp.normalize("a  b①") != f"{MARK}a{MARK}{MARK}b①":
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = {i for i in range(len(self.pieces)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in special if sp.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.special = special
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.alphabet = {p for p in self.ids if len(p) == 1}
        # Ranks: the alphabet first, then merges by falling score. Pieces that share a score
        # have no fixed order between them, so units that can hold one are merged step by step.
        shared: dict[float, int] = {}
        for p, s in self.score.items():
            if len(p) > 1:
                shared[s] = shared.get(s, 0) + 1
        self.tied = {p for p, s in self.score.items() if len(p) > 1 and shared[s] > 1}
        order = sorted(self.ids, key=lambda p: (len(p) > 1, -self.score[p] if len(p) > 1 else 0.0, self.ids[p]))
        self.rank = {p: r for r, p in enumerate(order)}
        self.split: dict[str, tuple[str, str]] = {}
        odd: set[str] = set()
        for p in order:
            if len(p) == 1:
                continue
            got = self._merge(p)
            halves = self._last_merge(p)
            if got != [p] or halves is None or any(len(h) > 1 and self.rank[h] > self.rank[p] for h in halves):
                odd.add(p)
            else:
                self.split[p] = halves
        self.odd = odd | self.tied
        if any(p.strip(MARK) for p in self.odd):
            raise ValueError("pieces other than runs of the marker have no fixed order of merging")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.shorter: dict[str, str] = {}
        for p in self.ids:
            self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), "")
        #: what may follow a piece, as far as it has been asked
        self.after: dict[str, dict[str, bool]] = {p: {} for p in self.ids}
        self.asked = 0
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        strange = "".join(sorted({c for p in self.ids for c in p} - self.alphabet))
        if strange:
            raise ValueError("a piece holds characters that are not in the alphabet")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word marker after other characters")
        self.units_re = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        self.newline_free = "\n" not in self.alphabet
        # what an id that is no byte decodes to; control ids show nothing
        self.shown = {i: "" if i in special else p.replace(MARK, " ") for i, p in enumerate(self.pieces) if i not in self.id_byte}
        self.as_ids: dict[str, str] = {}
        self.as_text: dict[str, str] = {}
        self.closing: dict[str, tuple[str, str]] = {}
        self.closing_signs = frozenset(".,!") & self.alphabet

    # -- merging step by step: builds the table of splits, and handles tied pieces ------
    def _merge(self, s: str) -> list[str]:
        sym: list[str] = list(s)
        left, right = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (m := sym[a] + sym[b]) in self.score:
                heapq.heappush(heap, (-self.score[m], a, b, m))

        for a in range(len(s) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, m = heapq.heappop(heap)
            if not sym[a] or not sym[b] or sym[a] + sym[b] != m or right[a] != b:
                continue
            sym[a], sym[b] = m, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [x for x in sym if x]

    def _last_merge(self, p: str) -> tuple[str, str] | None:
        """The two pieces that the last merge of ``p`` joins."""
        score = self.score.pop(p)
        try:
            parts = self._merge(p)
        finally:
            self.score[p] = score
        return (parts[0], parts[1]) if len(parts) == 2 else None

    # -- backtracking -------------------------------------------------------------------
    def _remerge(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` may stand side by side: undo their merges from the border
        outwards and look for an earlier merge that would have crossed it."""
        rank, split, limit = self.rank, self.split, 1 << 60
        while True:
            joined = a + b
            if joined in split and split[joined] == (a, b) and rank[joined] < limit:
                return False
            if rank[a] > rank[b]:
                limit = rank[a]
                if a in split:
                    a = split[a][1]
                else:
                    limit = rank[b] + 1
                    if b not in split:
                        return True
                    b = split[b][0]
            else:
                limit = rank[b] + 1
                if b in split:
                    b = split[b][0]
                else:
                    limit = rank[a]
                    if a not in split:
                        return True
                    a = split[a][1]

    def _compatible(self, a: str, b: str) -> bool:
        self.asked += 1
        if self.asked > 400_000:
            for known in self.after.values():
                known.clear()
            self.asked = 0
        got = self.after[a][b] = self._remerge(a, b)
        return got

    def _backtrack(self, s: str) -> list[str]:
        longest = [1] * len(s)
        for end, n in self.automaton.iter(s):
            longest[end - n + 1] = n  # ends rise, so the last match from a place is its longest
        if len(s) > LONG:
            return self._backtrack_long(s, longest)
        after, shorter = self.after, self.shorter
        failed = 0
        size = len(s)
        # nothing stands before the first piece: the longest one is tried at once
        piece = last = s[: longest[0]]
        pos = len(piece)
        out = [piece]
        piece = s[pos : pos + longest[pos]] if pos < size else ""
        while pos < size:
            known = after[last] if last else None
            while piece:
                end = pos + len(piece)
                if not failed or not failed >> end & 1:
                    if known is None:
                        break
                    fits = known.get(piece)
                    if fits or fits is None and self._compatible(last, piece):
                        break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                pos, last = end, piece
                piece = s[pos : pos + longest[pos]] if pos < size else ""
            elif out:
                failed |= 1 << pos
                piece = shorter[out[-1]]
                pos -= len(out.pop())
                last = out[-1] if out else ""
            else:
                return self._merge(s)
        return out

    def _backtrack_long(self, s: str, longest: list[int]) -> list[str]:
        """The same walk with the bitfield in bytes, so that a step costs the same at any length."""
        after, shorter = self.after, self.shorter
        size = len(s)
        failed = bytearray(size // 8 + 1)
        out: list[str] = []
        pos, piece, last = 0, s[: longest[0]], ""
        while pos < size:
            while piece:
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = True if not last else after[last].get(piece)
                    if fits or fits is None and self._compatible(last, piece):
                        break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                pos, last = end, piece
                piece = s[pos : pos + longest[pos]] if pos < size else ""
            elif out:
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= len(piece)
                last = out[-1] if out else ""
            else:
                return self._merge(s)
        return out

    def _known(self, s: str) -> list[int]:
        """The ids of a string over the alphabet. Runs of the marker, whose pieces share their
        scores and so have no order of merging between them, are merged step by step."""
        pieces = self._merge(s) if MARK * 2 in s else self._backtrack(s)
        return list(map(self.ids.__getitem__, pieces))

    def encode_unit(self, unit: str) -> list[int]:
        if self.alphabet.issuperset(unit):
            return self._known(unit)
        ids: list[int] = []
        run: list[str] = []
        for c in [*unit, ""]:
            if c in self.alphabet:
                run.append(c)
                continue
            if run:
                ids += self._known("".join(run))
                run = []
            ids += [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
        return ids

    def decode_unit(self, ids: list[int]) -> str:
        """Pieces joined, markers as spaces, bytes as UTF-8; the dummy prefix stays."""
        try:
            return "".join(map(self.shown.__getitem__, ids))
        except KeyError:
            pass
        out, raw = [], bytearray()
        for i in ids:
            if i in self.id_byte:
                raw.append(self.id_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.shown[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if self.newline_free and text[0] != " " and "  " not in text and MARK not in text:
            return list(filter(None, (MARK + text.replace(" ", f" {MARK}").replace("\n", " \n ")).split(" ")))
        return self.units_re.findall(MARK + text.replace(" ", MARK))

    def _learn(self, units: list[str]) -> None:
        if len(self.as_ids) > CACHE_UNITS:
            self.as_ids.clear()
            self.as_text.clear()
        known, closing = self.as_ids, self.closing
        for u in set(units).difference(known):
            if len(u) > 2 and u[-1] in self.closing_signs and u[-2:] not in self.inside and (head := known.get(u[:-1])):
                # no piece crosses into the closing sign, so the two parts stand for themselves
                sign = closing.get(u[-1])
                if sign is None:
                    ids = self.encode_unit(u[-1])
                    # a piece of the alphabet, so no bytes run on into it: it decodes by itself
                    sign = closing[u[-1]] = (",".join(map(str, ids)), self.decode_unit(ids))
                known[u] = f"{head},{sign[0]}"
                self.as_text[u] = self.as_text[u[:-1]] + sign[1]
                continue
            ids = self.encode_unit(u)
            known[u] = ",".join(map(str, ids))
            self.as_text[u] = self.decode_unit(ids)

    def both(self, text: str) -> tuple[str, str]:
        """The ids, in decimal and joined by commas, and the text that they decode to."""
        units = self.units(text)
        if not units:
            return "", ""
        try:
            ids = ",".join(map(self.as_ids.__getitem__, units))
        except KeyError:
            self._learn(units)
            ids = ",".join(map(self.as_ids.__getitem__, units))
        decoded = "".join(map(self.as_text.__getitem__, units))
        return ids, decoded[1:] if decoded.startswith(" ") else decoded

    def encode(self, text: str) -> list[int]:
        ids = self.both(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        text = self.decode_unit(ids)
        return text[1:] if text.startswith(" ") else text


@lru_cache(4)
def encoder(model_path: str) -> MergeEncoder:
    return MergeEncoder(model_path)


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, and with ``keep_ids``
    the ids themselves and the decoded text. ``model_path`` must be readable on executors."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = encoder(model_path)
        counts, a, b, ids_out, texts = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            ids, decoded = codec.both(text or "")
            counts.append(ids.count(",") + 1 if ids else 0)
            a.append(hashlib.sha256(ids.encode()).hexdigest())
            b.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            if keep_ids:
                ids_out.append([int(i) for i in ids.split(",")] if ids else [])
                texts.append(decoded)
        cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            cols += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            names += ["ids", "decoded"]
        return pa.record_batch(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(only(docs, "doc_id", "text"), encode, schema + (", ids array<int>, decoded string" if keep_ids else ""))
