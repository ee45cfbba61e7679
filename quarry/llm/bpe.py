"""BPE encoding and decoding (operator 2): speculate, verify, and merge exactly only where needed.

A word is first cut greedily into the longest vocabulary pieces. BPE's own result is the only
sequence of reachable tokens in which no adjacent pair would have merged across its border, so the
guess is right when every adjacent pair is compatible. All pairs of a batch are tested at once in
numpy. Words with an incompatible pair are merged exactly, by rank. Texts are split into
words, and words are looked up in the worker's bounded memo, with array operations, so the exact
work follows the vocabulary rather than the text.

A pair (a, b) is incompatible when some piece p on the right edge of a and some piece q on the left
edge of b would merge at a rank r at which both exist: p and q were made before r, p is not used up
before or at r, and q is not used up before r (of equal ranks the leftmost merges first).

Supported: tokenizer files with a BPE model over byte-level symbols and word ends, whose
normaliser and
splitter are those of ``word_bpe_49k.json``; others are refused.

Edge cases: null and empty texts have no ids; the special strings are cut out of raw texts first; texts of any length
are handled whole; repeated rows are encoded each for itself; of pairs of equal rank the leftmost merges first; an empty table
gives no rows; a column named like the new one is replaced, all others are carried, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .shared import numbered, table, with_fields

#: Words that a worker's memo holds before it starts again; about 60 bytes each.
MEMO_WORDS = 1_000_000
_NEVER = 1 << 40

#: The splitter of the tokenizer file, with its white space written as the Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Outside these ranges Unicode versions may disagree on letters and cases; the tokenizers library then splits the text.
_RARE = regex.compile("[^\u0000-\u052f\u2000-\u2060\u20a0-\u20bf\u3000-\u30ff]")
_BLANK, _LETTER, _DIGIT, _MARK = 0, 1, 2, 3
_KIND = np.full(0x3100, _MARK, np.uint8)
for _c in range(len(_KIND)):
    if unicodedata.category(chr(_c))[0] in "LN":
        _KIND[_c] = _LETTER if unicodedata.category(chr(_c))[0] == "L" else _DIGIT
    elif regex.match(r"\p{White_Space}", chr(_c)):
        _KIND[_c] = _BLANK
_CODES = [K.mix(np.arange(1, len(_KIND) + 1, dtype=np.uint64) * np.uint64(m)) for m in (0xD1342543DE82EF95, 0xA24BAED4963EE407)]


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != SPLIT or model["byte_fallback"] or model["dropout"]:
            raise ValueError(f"{path}: not a tokenizer file of the supported kind")
        self.path, self.library = path, None
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.symbols = str.maketrans({b: s for b, s in enumerate(byte_symbols())})
        merges = [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in model["merges"]]
        n = max([*self.vocab.values(), *self.special.values()]) + 1
        self.n = n
        self.token_bytes = [b""] * n
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token_bytes[i] = t.encode()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right, self.made = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        for r, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((x, y), (r, z))
            if self.left[z] < 0:
                self.left[z], self.right[z], self.made[z] = x, y, r
        self._hash([x * n + y for x, y in self.rank], [r for r, _ in self.rank.values()])
        self.merged = np.zeros(len(merges), np.int64)
        for r, z in self.rank.values():
            self.merged[r] = z
        valid = self._reachable()
        self.pieces = {t: i for t, i in self.vocab.items() if valid[i]}
        self.longest = max(map(len, self.pieces))
        self._forget()

    # -- verification -------------------------------------------------------------------------

    def _hash(self, keys: list[int], ranks: list[int]) -> None:
        """An open-addressing table of merges, for lookups of whole arrays."""
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.slot_key, self.slot_rank = np.full(size + 64, -1, np.int64), np.full(size + 64, _NEVER)
        self.probes = 1
        home = ((np.array(keys, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64).tolist()
        for k, r, at in zip(keys, ranks, home, strict=True):
            to = at
            while self.slot_key[to] >= 0:
                to += 1
            self.slot_key[to], self.slot_rank[to] = k, r
            self.probes = max(self.probes, to - at + 1)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        hit = self.slot_key[at]
        out = np.where(hit == key, self.slot_rank[at], _NEVER)
        on = np.flatnonzero((hit != key) & (hit >= 0))
        for _ in range(1, self.probes):
            if not len(on):
                break
            at.flat[on] += 1
            hit = self.slot_key[at.flat[on]]
            same = hit == key.flat[on]
            out.flat[on[same]] = self.slot_rank[at.flat[on[same]]]
            on = on[~same & (hit >= 0)]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = _NEVER) -> np.ndarray:
        """For each pair of tokens: does no merge across the border take place (at a rank under ``before``)?"""
        ok = np.ones(len(a), bool)
        idx = np.arange(len(a))
        before = np.broadcast_to(np.asarray(before), len(a))
        p, p_used = a, np.full(len(a), _NEVER)
        while len(idx):  # down the right edge of a
            q, q_used, j = b[idx], np.full(len(idx), _NEVER), np.arange(len(idx))
            while len(j):  # down the left edge of b
                r = self._ranks(p[j], q)
                bad = (r < before[idx[j]]) & (r > self.made[p[j]]) & (r > self.made[q]) & (r < p_used[j]) & (r <= q_used)
                ok[idx[j[bad]]] = False
                go = (self.left[q] >= 0) & ~bad
                q, q_used, j = self.left[q[go]], self.made[q[go]], j[go]
            go = (self.right[p] >= 0) & ok[idx]
            p, p_used, idx = self.right[p[go]], self.made[p[go]], idx[go]
        return ok

    def _reachable(self) -> np.ndarray:
        """Tokens that merging their own symbols yields."""
        valid = np.ones(self.n, bool)
        made = np.flatnonzero(self.made >= 0)
        made = made[np.argsort(self.made[made])]
        border = self.compatible(self.left[made], self.right[made], self.made[made])
        for t, ok in zip(made.tolist(), border.tolist(), strict=True):
            valid[t] = ok and valid[self.left[t]] and valid[self.right[t]]
        return valid

    # -- words --------------------------------------------------------------------------------

    def _guess(self, symbols: str) -> list[int] | None:
        out, at, n, pieces, full = [], 0, len(symbols), self.pieces, symbols + self.suffix
        while at < n:
            x = pieces.get(full[at:]) if n - at <= self.longest else None
            if x is not None:
                out.append(x)
                return out
            for to in range(min(n, at + self.longest), at, -1):
                x = pieces.get(symbols[at:to]) if to < n else None
                if x is not None:
                    break
            else:
                return None
            out.append(x)
            at = to
        return out

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Exact merging of many words at once: in each round every word does its lowest rank, leftmost first."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        lo = 0
        while lo < len(order):  # words of about the same length share an array
            top, hi = max(8, 2 * len(words[order[lo]])), lo
            while hi < len(order) and len(words[order[hi]]) <= top and (hi == lo or (hi - lo) * top < 1 << 18):
                hi += 1
            own = order[lo:hi]
            width = len(words[own[-1]])
            ids = np.full((len(own), width), -1)
            for k, i in enumerate(own):
                w = words[i]
                ids[k, : len(w)] = [self.vocab[s] for s in w[:-1]] + [self.vocab[w[-1] + self.suffix]]
            for k, x in enumerate(self._merge_rows(ids)):
                out[own[k]] = x
            lo = hi
        return out

    def _merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        done: list[np.ndarray] = [ids[0]] * len(ids)
        rows = np.arange(len(ids))
        while len(rows):
            if ids.shape[1] > 1:
                ranks = np.where(ids[:, 1:] >= 0, self._ranks(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0)), _NEVER)
                best = ranks.min(axis=1)
            else:
                best = np.full(len(ids), _NEVER)
            for k in np.flatnonzero(best == _NEVER).tolist():
                done[rows[k]] = ids[k][ids[k] >= 0]
            go = best != _NEVER
            if not go.any():
                break
            rows, ids, ranks, best = rows[go], ids[go], ranks[go], best[go]
            hit = ranks == best[:, None]
            # in a run of overlapping hits every other one counts, from the left
            place = np.arange(hit.shape[1])
            last = np.maximum.accumulate(np.where(hit, -1, place), axis=1)
            hit &= (place - last) % 2 == 1
            r, c = np.nonzero(hit)
            ids[r, c] = self.merged[best[r]]
            ids[r, c + 1] = -1
            keep = ids >= 0
            size = keep.sum(axis=1)
            packed = np.full((len(ids), int(size.max())), -1)
            packed[np.arange(packed.shape[1]) < size[:, None]] = ids[keep]
            ids = packed
        return done

    def encode_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each word)."""
        symbols = [w.encode().decode("latin-1").translate(self.symbols) for w in new]
        guess = [self._guess(s) or [] for s in symbols]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter(chain.from_iterable(guess), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(new)), sizes)
        same = np.flatnonzero(word[1:] == word[:-1])
        pairs, inverse = np.unique(flat[same] * self.n + flat[same + 1], return_inverse=True)
        ok = self.compatible(pairs // self.n, pairs % self.n)
        wrong = np.union1d(word[same[~ok[inverse]]], np.flatnonzero(sizes == 0))
        if not len(wrong):
            return flat, sizes
        exact = self.merge([symbols[i] for i in wrong.tolist()])
        begin = np.cumsum(sizes) - sizes
        parts, at = [], 0
        for i, x in zip(wrong.tolist(), exact, strict=True):
            parts += [flat[at : begin[i]], x]
            at = begin[i] + sizes[i]
            sizes[i] = len(x)
        return np.concatenate([*parts, flat[at:]]), sizes

    # -- texts --------------------------------------------------------------------------------

    def _library_words(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self.library = Tokenizer.from_file(self.path).normalizer, pre_tokenizers.Split(Regex(SPLIT), "removed", invert=True)
        normalizer, splitter = self.library
        return [w for w, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text))]

    def _one(self, text: str) -> np.ndarray:
        """Ids of a text with special strings or characters that the vectorised splitter does not know."""
        out, at = [], 0
        for m in [*self.special_re.finditer(text), None] if self.special_re else [None]:
            words = self._library_words(text[at : m.start() if m else len(text)])
            if words:
                out.append(self.encode_words(words)[0])
            if m:
                out.append(np.array([self.special[m[0]]]))
                at = m.end()
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _fast(self, text: str) -> str | None:
        """The normalised text, or None where only the slow way is sure."""
        if not text.isascii():
            if _RARE.search(text):
                return None
            text = unicodedata.normalize("NFC", text)
        if "<|" in text and self.special_re and self.special_re.search(text):
            return None
        text = text.replace("\u03a3", "\u03c3").lower()  # lower() would look at what follows a capital sigma
        return None if not text.isascii() and _RARE.search(text) else text

    def encode(self, texts: list[str | None], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each)."""
        ids: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        group: list[str] = []
        where: list[int] = []
        size = 0

        def flush():
            nonlocal size
            if group:
                flat, own = self._group(group)
                counts[where] = own
                ids.append(flat)
            group.clear()
            where.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            fast = self._fast(text)
            if fast is None:
                flush()
                x = self._one(text)
                counts[i] = len(x)
                ids.append(x)
                continue
            group.append(fast)
            where.append(i)
            size += len(fast)
            if size >= limit:
                flush()
        flush()
        return (np.concatenate(ids) if ids else np.zeros(0, np.int64)).astype("<u4"), counts

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = _KIND[code]
        start = np.empty(len(code), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == _DIGIT
        mark = np.flatnonzero((code == 39) & start)
        if len(mark):  # contractions: an apostrophe that begins a run of marks, and s, t, m, d, re, ve or ll
            a, b = code[np.minimum(mark + 1, len(code) - 1)], code[np.minimum(mark + 2, len(code) - 1)]
            two = np.isin(a, (115, 116, 109, 100))
            three = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            for own, n in ((mark[two], 2), (mark[three], 3)):
                start[own + 1] = False
                start[own + n] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(code))
        own = kind[begin] != _BLANK
        begin, end = begin[own], end[own]
        pw, ip = K.powers(len(code))
        word_hash = []
        for table in _CODES:
            sums = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(table[code] * pw[: len(code)], out=sums[1:])
            word_hash.append(K.mix((sums[end] - sums[begin]) * ip[begin]))
        h1, h2 = word_hash
        keys, first, inverse = np.unique(h1, return_index=True, return_inverse=True)
        slots = self._slots(keys, h2[first], begin[first], end[first], joined)
        word = slots[inverse]
        if (self.check[word] != h2).any():
            raise RuntimeError("two words share a 64-bit hash")
        n = self.count[word]
        at = np.cumsum(n)
        flat = self.store[np.repeat(self.begin[word] - (at - n), n) + np.arange(at[-1] if len(at) else 0)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        cut = np.concatenate(([0], np.searchsorted(begin, ends)))
        return flat, np.diff(np.concatenate(([0], at))[cut])

    def _slots(self, keys, check, begin, end, joined) -> np.ndarray:
        """The memo's slots of words (sorted hashes); unknown words are encoded. A full memo starts again."""
        if self.words_known + len(keys) > MEMO_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(0, len(self.keys) - 1))
        known = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool)
        slots = np.where(known, self.slot_of[near], -1) if len(self.keys) else np.full(len(keys), -1)
        new = np.flatnonzero(~known)
        if len(new):
            flat, sizes = self.encode_words([joined[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
            base, used = self.words_known, self.used
            slots[new] = np.arange(base, base + len(new))
            self.keys, self.slot_of = np.insert(self.keys, at[new], keys[new]), np.insert(self.slot_of, at[new], slots[new])
            self.words_known += len(new)
            while used + len(flat) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            while self.words_known > len(self.begin):
                self.begin, self.count, self.check = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.check))
            self.store[used : used + len(flat)] = flat
            own = slice(base, base + len(new))
            self.begin[own], self.count[own], self.check[own] = used + np.cumsum(sizes) - sizes, sizes, check[new]
            self.used = used + len(flat)
        return slots

    def _forget(self) -> None:
        self.keys, self.slot_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes of known words, ascending, and their slots
        self.words_known = self.used = 0
        self.store = np.zeros(1 << 16, np.uint32)
        self.begin, self.count, self.check = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.uint64)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, as the file has no decoder."""
        return b" ".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a tokenizer file; its memo outlives a task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks(batch: pa.RecordBatch, at: int, limit: int = 4 << 20):
    """Parts of a batch with at most ``limit`` bytes in column ``at``, or of one row."""
    _, off = K.column_bytes(batch.column(at))
    for lo, hi in K.slices(off, limit):
        yield batch.slice(lo, hi - lo)


def encode(docs: DataFrame, *, text_col: str = "text", path: str | None = None, ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text as an array; ``path`` must exist on every executor.

    With ``decoded_col`` also with the text decoded from them, by the same worker, so that no second one holds a codec and the rows.
    """
    path = path or default_path()
    docs = docs.drop(*[c for c in (ids_col, decoded_col) if c and c != text_col])
    at, plain = docs.columns.index(text_col), numbered(docs)
    new = ["ids", "decoded"] if decoded_col else ["ids"]

    def run(batches):
        c = codec(path)
        for whole in batches:
            for batch in chunks(whole, at):
                ids, n = c.encode(batch.column(at).to_pylist())
                cut = np.concatenate(([0], np.cumsum(n)))
                cols = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32)))]
                if decoded_col:
                    cols.append(pa.array([c.decode(ids[lo:hi].tobytes()) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *new])
        K.trim()

    schema = with_fields(plain, "ids array<int>" + (", decoded string" if decoded_col else ""))
    return plain.mapInArrow(run, schema).toDF(*docs.columns, ids_col, *([decoded_col] if decoded_col else []))


def decode(docs: DataFrame, *, ids_col: str = "ids", path: str | None = None, text_col: str = "decoded") -> DataFrame:
    """``docs`` with the decoded text of an array of ids; null ids decode to the empty text."""
    path = path or default_path()
    docs = docs.drop(*([text_col] if text_col != ids_col else []))
    at, plain = docs.columns.index(ids_col), numbered(docs)

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
        K.trim()

    return plain.mapInArrow(run, with_fields(plain, "decoded string")).toDF(*docs.columns, text_col)


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Digests of the ids of each text and of the text decoded from them; ids do not leave the worker."""
    path = path or default_path()
    docs = docs.select(id_col, text_col)

    def run(batches):
        c = codec(path)
        for whole in batches:
            for batch in chunks(whole, 1):
                flat, n = c.encode(batch.column(1).to_pylist())
                raw, cut = flat.tobytes(), [0, *(4 * np.cumsum(n)).tolist()]
                ids = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(n, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids]),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        K.trim()

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
