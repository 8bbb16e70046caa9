"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The encoder never applies merges. An Aho-Corasick automaton lists the tokens that occur in a pre-token; from the left,
the longest token that starts at a position is tried, and kept if it is compatible with the token before it; otherwise
the next shorter one, and if none is left the token before is given up. Two tokens are compatible if applying the
merge rules to their joined text leaves the border between them: the merges inside both are undone from the latest
on, and at no time may a rule of lower rank join the two symbols at the border. The accepted sequence is exactly what
the merge rules give; visited positions are marked, so the work is linear in the length.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import giving_back, tokenizer_path

#: Runs between white space, and pre-tokens, whose ids a Python worker keeps: some 20 and 70 MB. Pre-tokens are fewer than
#: runs and take longer to encode.
CACHE, WORDS = 80_000, 300_000
#: Pairs of tokens of which a Python worker knows whether they fit.
FITS = 300_000
#: Unicode white space, as the tokenizer's normaliser has it (not the ASCII separators that Python adds).
_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_END = "\x00"  # stands for the end of a word; the byte alphabet has no such character


def byte_alphabet() -> list[str]:
    """The printable character for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    spare = {b: chr(256 + i) for i, b in enumerate(b for b in rest if b not in own)}
    return [spare.get(b, chr(b)) for b in range(256)]


class _Runs(dict):
    """Ids of runs between white space; those not known are encoded."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe

    def __missing__(self, run: str) -> bytes:
        ids = self.bpe.encode_run(run)
        if len(run) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[run] = ids
        return ids


class WordBpe:
    """A tokenizer file of kind BPE with a byte alphabet and a suffix at word ends."""

    def __init__(self, path: str, words: int = WORDS):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(rf"\p{{L}}+|'s|'t|'re|'ve|'m|'ll|'d|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.alphabet = byte_alphabet()
        self.table = {b: c for b, c in enumerate(self.alphabet)}
        inner = lambda t: t[: -len(self.suffix)] + _END if self.suffix and t.endswith(self.suffix) else t
        self.by_text = {inner(t): i for t, i in vocab.items()}
        self.joins: dict[tuple[int, int], tuple[int, int]] = {}
        self.rule: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[(a[: -len(self.suffix)] if self.suffix and a.endswith(self.suffix) else a) + b]
            self.joins.setdefault((left, right), (rank, made))
            self.rule.setdefault(made, (rank, left, right))
        # for each token the longest shorter one that starts it
        self.shorter: dict[int, tuple[int, int] | None] = {}
        for text, i in self.by_text.items():
            cut = next((k for k in range(len(text) - 1, 0, -1) if text[:k] in self.by_text), 0)
            self.shorter[i] = (cut, self.by_text[text[:cut]]) if cut else None
        self.automaton = ahocorasick.Automaton()
        for text, i in self.by_text.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        # the offset table: token i is blob[offsets[i]:offsets[i + 1]]
        size = max([*vocab.values(), *self.special.values()]) + 1
        texts = [b""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            texts[i] = t.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        digits = [b"%d" % i for i in range(size)]
        self.digit_offsets = np.concatenate([[0], np.cumsum([len(t) for t in digits])]).astype(np.int64)
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.known: dict[str, bytes] = {}
        self.most_known = words
        self.runs = _Runs(self)

    def compatible(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > FITS:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Undo the merges beside the border, latest first, and look for a rule that would have come before.

        Of equal ranks the leftmost position merges first: the border comes before merges to its right and after
        those to its left.
        """
        bound = float("inf")
        while True:
            join = self.joins.get((a, b))
            if join and join[0] < bound:
                return False
            rank_a = self.rule[a][0] if a in self.rule else -1
            rank_b = self.rule[b][0] if b in self.rule else -1
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                bound, a = rank_a, self.rule[a][2]
            else:
                bound, b = rank_b + 0.5, self.rule[b][1]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        # printable ASCII stands for itself
        text = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.table)
        if self.suffix:
            text += _END
        n = len(text)
        longest = [None] * n  # by start; ends ascend, so the longest match is the last
        for end, match in self.automaton.iter(text):
            longest[end + 1 - match[0]] = match
        shorter, fits = self.shorter, self.fits
        at, ids, kept = 0, [], []
        dead: set[int] = set()
        match = longest[0] if n else None
        while at < n:
            while match is not None:
                length, token = match
                if at + length not in dead:
                    if not ids:
                        break
                    pair = (ids[-1], token)
                    if fits[pair] if pair in fits else self.compatible(*pair):
                        break
                match = shorter[token]
            if match is not None:
                ids.append(token)
                kept.append((at, match))
                at += length
                match = longest[at] if at < n else None
            elif ids:
                dead.add(at)
                ids.pop()
                at, match = kept.pop()
                match = shorter[match[1]]
            else:
                raise ValueError("no sequence of tokens spells this word")
        return ids

    def normalized(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # character by character, so a sigma at a word's end is no special case
        return "σ".join(part.lower() for part in text.split("Σ")) if "Σ" in text else text.lower()

    def encode_run(self, run: str) -> bytes:
        """Ids, as bytes, of text without special tokens."""
        out, known = [], self.known
        words = (run.lower(),) if run.isascii() and run.isalpha() else self.words.findall(self.normalized(run))
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = array("i", self.encode_word(word)).tobytes()
                if len(word) <= 64:
                    if len(known) >= self.most_known:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; the strings of special tokens become those tokens.

        No pre-token holds white space, so runs between white space are encoded each, the known ones by a look-up.
        """
        parts = self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.int32(self.special[part]).tobytes())
            elif any(c in part for c in "\x1c\x1d\x1e\x1f"):  # split() takes these for white space
                out.append(self.encode_run(part))
            else:
                out.extend(map(self.runs.__getitem__, part.split()))
        return np.frombuffer(b"".join(out), np.int32)

    @staticmethod
    def _spelled(ids: np.ndarray, blob: np.ndarray, offsets: np.ndarray) -> bytes:
        """The tokens' bytes, joined by one space, gathered through an offset table."""
        if not len(ids):
            return b""
        lengths = offsets[ids + 1] - offsets[ids]
        firsts = np.cumsum(lengths + 1) - (lengths + 1)
        total = int(firsts[-1] + lengths[-1])
        at = np.arange(total, dtype=np.int64)
        at += np.repeat(offsets[ids] - firsts, lengths + 1)[:total]
        at[firsts[1:] - 1] = 0
        out = blob[at]
        out[firsts[1:] - 1] = 0x20
        return out.tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return self._spelled(ids, self.blob, self.offsets)

    def id_text(self, ids: np.ndarray) -> bytes:
        return self._spelled(ids, self.digits, self.digit_offsets)


@lru_cache(maxsize=2)
def load(name: str, words: int = WORDS) -> WordBpe:
    return WordBpe(tokenizer_path(name), words)


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, words: int = WORDS) -> DataFrame:
    """Returns id, n_tokens, ids_sha256, decoded_sha256 of each row and, with ``keep_ids``, ids and decoded. ``words``:
    pre-tokens whose ids a Python worker keeps.

    A null or empty text has no tokens and the empty string's digests. Rows with the same id are encoded each; a null
    id stays null; an empty table gives an empty result; other columns are ignored. There is no shuffle.
    """
    kind = dict(df.dtypes)[id_col]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches):
        bpe = load(tokenizer, words)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                some = batch.slice(part, 256)
                rows: list[list] = [[] for _ in names[1:]]
                for text in some.column(1):
                    ids = bpe.encode(text.as_py() or "")
                    decoded = bpe.decode(ids)
                    values = [len(ids), hashlib.sha256(bpe.id_text(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    for column, value in zip(rows, values + [ids, decoded.decode()] * keep_ids, strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * keep_ids
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], names)
        load.cache_clear()  # the worker lives on, with other work

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(run), schema).withColumnRenamed("doc_id", id_col)
