"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as an incremental state machine.

Merges are applied in rank order, so what stands far to the right can only reach a token through a chain of merges of rising
rank, each of which moves the first doubtful boundary left by the length of its left part. ``lookahead`` computes the longest
such chain of a merge list once. A token is stable as soon as that many symbols follow it: it is emitted and forgotten, so an
endless run of letters is encoded in constant memory (the ids of a text are one list). Words within the lookahead end before
anything in them is stable; those that are new to a worker are merged together, each taking its next merge in every step.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlane.llm.common import map_arrow, sql_type, table

#: The split pattern that the byte-level pre-tokenizer uses unless told otherwise.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FEED = 4096
_MEMO_ENTRIES, _MEMO_LENGTH = 250_000, 48
#: Texts are encoded together up to so many rows and characters; words of up to so many bytes are merged together.
_ROWS, _CHARS, _TOGETHER, _FEW = 1000, 400_000, 48, 8
#: Ids that the numbered runs of a worker take up at most before they are forgotten.
_POOL = 8_000_000
_SHIFT, _NONE, _NO_RANK = 32, 1 << 62, np.iinfo(np.int32).max


def _glyphs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: itself if visible Latin-1, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


_GLYPHS = _glyphs()
_BYTES = {g: b for b, g in enumerate(_GLYPHS)}
_TO_GLYPHS = {b: g for b, g in enumerate(_GLYPHS)}


class Memo(dict):
    """Computed values of short strings; it starts anew when full, so its size is bounded."""

    def __init__(self, compute, entries: int = _MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= _MEMO_LENGTH:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


class Met:
    """Strings that a worker has met and their ids, in one array; it starts anew when full, so its size is bounded."""

    def __init__(self, entries: int = _MEMO_ENTRIES):
        self.entries = entries
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict = {}
        self.signs = 0
        self.starts, self.lengths, self.ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)

    def new_among(self, keys: list) -> list:
        """The distinct keys that have no number yet; all of them where what has been met is forgotten."""
        distinct = set(keys)
        new = distinct.difference(self.numbers)
        if len(self.numbers) + len(new) > self.entries or max(len(self.ids), self.signs) > _POOL:
            self._forget()
            new = distinct
        return list(new)

    def add(self, keys: list, ids: list) -> None:
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.add_flat(keys, np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(lengths.sum())), lengths)

    def add_flat(self, keys: list, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.numbers.update(zip(keys, range(len(self.numbers), len(self.numbers) + len(keys))))
        self.signs += sum(map(len, keys))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, flat])

    def ids_of(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys in a row, and how many each has."""
        numbers = np.fromiter(map(self.numbers.__getitem__, keys), dtype=np.int64, count=len(keys))
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(lengths.sum())], lengths


class Merges:
    """A vocabulary with ranked merges. Symbols are token ids throughout."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        #: The rank of each pair, both ids in one number; what each rank makes.
        self.ranks = {vocab[a] << _SHIFT | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.single = {g: vocab.get(g) for g in _GLYPHS}
        self.final = {g: vocab.get(g + suffix) for g in _GLYPHS}
        self.lookahead = self._longest_chain(pairs) + 1
        codes = np.fromiter(self.ranks, dtype=np.int64, count=len(self.ranks))
        order = np.argsort(codes)
        self._codes, self._rank = codes[order], np.fromiter(self.ranks.values(), dtype=np.int32, count=len(codes))[order]
        self._made = np.array(self.made, dtype=np.int32)
        self._single, self._final = (np.array([-1 if t[g] is None else t[g] for g in _GLYPHS], dtype=np.int32) for t in (self.single, self.final))

    def _longest_chain(self, pairs: list[tuple[str, str]]) -> int:
        """Symbols by which text to the right can move a boundary.

        A merge (u, v) moves the first doubtful boundary from the end of u to its start. A later merge (u', v') moves it on
        only if v' starts there, that is if u is v' or begins it: is v', its left part, that one's left part, and so on.
        """
        size = lambda token: len(token.removesuffix(self.suffix)) if self.suffix else len(token)
        left: dict[str, str] = {}
        reach: dict[str, int] = {}
        for u, v in pairs:
            part, most = v, 0
            while part is not None:
                most, part = max(most, reach.get(part, 0)), left.get(part)
            reach[u] = max(reach.get(u, 0), most + size(u))
            left.setdefault(u + v, u)
        return max(reach.values(), default=0)

    def apply(self, symbols: list[int]) -> list[int]:
        """All merges in rank order, leftmost first."""
        if len(symbols) > 100:
            return self._apply_long(symbols)
        rank, made = self.ranks.get, self.made
        open_ = [rank(a << _SHIFT | b, _NONE) for a, b in zip(symbols, symbols[1:])]
        while open_ and (best := min(open_)) != _NONE:
            i = open_.index(best)
            symbols[i] = new = made[best]
            del symbols[i + 1], open_[i]
            if i:
                open_[i - 1] = rank(symbols[i - 1] << _SHIFT | new, _NONE)
            if i < len(open_):
                open_[i] = rank(new << _SHIFT | symbols[i + 1], _NONE)
        return symbols

    def _apply_long(self, symbols: list[int]) -> list[int]:
        symbols, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(found, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (found := rank(pair[0] << _SHIFT | pair[1])) is not None]
        heapq.heapify(heap)
        while heap:
            found, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = self.made[found], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (found := rank(symbols[left] << _SHIFT | symbols[right])) is not None:
                    heapq.heappush(heap, (found, left, (symbols[left], symbols[right])))
        return [s for s in symbols if s >= 0]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = left.astype(np.int64) << _SHIFT | right
        if not len(self._codes):
            return np.full(codes.shape, _NO_RANK, dtype=np.int32)
        at = np.minimum(np.searchsorted(self._codes, codes), len(self._codes) - 1)
        return np.where(self._codes[at] == codes, self._rank[at], _NO_RANK)

    def _apply_rows(self, symbols: np.ndarray) -> list[list[int]]:
        """All merges of each row. Every row that isn't finished takes one merge a step, so the unfinished ones stay of one width."""
        out: list[list[int]] = [[]] * len(symbols)
        rows, ranks = np.arange(len(symbols)), self._ranks_of(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            best = ranks.min(axis=1, initial=_NO_RANK)
            if (ended := best == _NO_RANK).any():
                for row, ids in zip(rows[ended].tolist(), symbols[ended].tolist()):
                    out[row] = ids
                rows, symbols, ranks, best = rows[~ended], symbols[~ended], ranks[~ended], best[~ended]
                if not len(rows):
                    break
            at, width, each = ranks.argmin(axis=1), symbols.shape[1] - 1, np.arange(len(rows))
            column = np.arange(width)
            symbols = np.take_along_axis(symbols, column + (column > at[:, None]), axis=1)
            symbols[each, at] = self._made[best]
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
            for some, shift in ((at > 0, -1), (at < width - 1, 0)):  # the pairs on either side of what was made
                i, j = each[some], at[some] + shift
                ranks[i, j] = self._ranks_of(symbols[i, j], symbols[i, j + 1])
        return out

    def apply_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of whole words that are within the lookahead, those of one length together."""
        out: list[list[int]] = [[]] * len(words)
        by_length = defaultdict(list)
        for place, word in enumerate(words):
            by_length[len(word)].append(place)
        for length, places in by_length.items():
            for at in range(0, len(places), 1 << 14):
                part = places[at : at + (1 << 14)]
                raw = np.frombuffer(b"".join([words[i] for i in part]), dtype=np.uint8).reshape(-1, length)
                symbols = np.concatenate([self._single[raw[:, :-1]], self._final[raw[:, -1:]]], axis=1)
                if length > _TOGETHER or len(part) < _FEW or (symbols < 0).any():
                    found = [self.apply([s for s in row if s >= 0]) for row in symbols.tolist()]
                else:
                    found = self._apply_rows(symbols)
                for i, ids in zip(part, found):
                    out[i] = ids
        return out

    def apply_word(self, glyphs: str) -> list[int]:
        """The ids of a whole word that is within the lookahead."""
        symbols = [self.single[g] for g in glyphs[:-1]]
        symbols.append(self.final[glyphs[-1]])
        return self.apply([s for s in symbols if s is not None] if None in symbols else symbols)

    def transduce(self, glyphs: str, feed: int = _FEED) -> Iterator[int]:
        """The token ids of one word, given as glyphs; each leaves as soon as nothing that follows can change it."""
        single, most = self.single, self.lookahead + feed
        held: list[int] = []
        for at in range(0, len(glyphs) - 1, feed):
            held += [s for g in glyphs[at : min(at + feed, len(glyphs) - 1)] if (s := single[g]) is not None]
            if len(held) >= most:
                stable, end = [], len(held) - self.lookahead
                for token in self.apply(held):
                    if (end := end - self.sizes[token]) < 0:
                        break
                    stable.append(token)
                yield from stable
                held = held[sum(self.sizes[t] for t in stable) :]
        last = self.final[glyphs[-1]]
        yield from self.apply(held if last is None else [*held, last])

    @property
    def sizes(self) -> dict[int, int]:
        """Symbols of each token."""
        if "_sizes" not in self.__dict__:
            self._sizes = {i: len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t, i in self.vocab.items()}
        return self._sizes


class Tokenizer:
    """Encodes and decodes as described by a tokenizer file in JSON with a BPE model over byte glyphs.

    Supported are byte-level pre-tokenizers, alone or behind a regex split that keeps its matches, and the normalizers NFC,
    replacement by regex, and lower case. Anything else is refused, so that no text is encoded wrongly.
    """

    def __init__(self, description: str):
        d = json.loads(description)
        model = d["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are supported")
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        steps = (d["normalizer"] or {"normalizers": []}).get("normalizers") or ([d["normalizer"]] if d["normalizer"] else [])
        self.normalizers = [self._normalizer(s) for s in steps]
        #: Whether the normalizers change single signs, their marks and runs of white space only, so words don't touch each other.
        self.local = all(s["type"] in ("NFC", "Lowercase") or (s["pattern"].get("Regex"), s["content"]) == (r"\s+", " ") for s in steps)
        pre = d["pre_tokenizer"].get("pretokenizers") or [d["pre_tokenizer"]]
        byte_level = pre[-1]
        if byte_level["type"] != "ByteLevel" or byte_level["add_prefix_space"] or len(pre) > 2:
            raise ValueError("only byte-level pre-tokenizers are supported")
        if len(pre) == 2:
            if byte_level["use_regex"] or pre[0]["type"] != "Split" or pre[0]["behavior"] != "Removed" or not pre[0]["invert"]:
                raise ValueError("only splits that keep their matches are supported")
            pattern = pre[0]["pattern"]["Regex"]
        else:
            pattern = BYTE_LEVEL_PATTERN
        self.words = regex.compile(pattern)
        #: Whether white space is dropped; ASCII white space then separates what is encoded apart.
        self.spaceless = not any(self.words.fullmatch(x) for x in (" ", " a", " 1", " .", "\n"))
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in d["added_tokens"]):
            raise ValueError("added tokens with conditions are not supported")
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.byte_level_text = (d["decoder"] or {}).get("type") == "ByteLevel"
        if d["decoder"] and not self.byte_level_text:
            raise ValueError("only byte-level decoders, or none, are supported")
        self.memo, self.word_memo = Memo(self._encode_run), Memo(self._encode_word)
        self.met_runs, self.met_words = Met(), Met()

    @staticmethod
    def _normalizer(step: dict):
        if step["type"] == "NFC":
            return lambda s: s if s.isascii() else unicodedata.normalize("NFC", s)
        if step["type"] == "Lowercase":
            return lambda s: s.replace("Σ", "σ").lower()  # sign by sign, so without the final form of sigma
        if step["type"] == "Replace" and "Regex" in step["pattern"]:
            pattern, to = regex.compile(step["pattern"]["Regex"]), step["content"]
            return lambda s: pattern.sub(to, s)
        raise ValueError(f"normalizer {step['type']} is not supported")

    def _encode_run(self, text: str) -> tuple[int, ...]:
        text = self._normalised(text)
        if self.spaceless and text.isalpha():
            return self.word_memo[text]
        return tuple(chain.from_iterable(map(self.word_memo.__getitem__, self.words.findall(text))))

    def _encode_word(self, word: str) -> tuple[int, ...]:
        if not (word.isascii() and word.isalnum()):
            word = word.encode("utf-8", "replace").decode("latin-1").translate(_TO_GLYPHS)
        if len(word) <= self.merges.lookahead:  # nothing is stable before the word ends
            return tuple(self.merges.apply_word(word))
        return tuple(self.merges.transduce(word))

    def _runs(self, text: str) -> Iterable[str]:
        """Parts that are encoded apart and remembered."""
        return text.translate(_ASCII_SPACE).split(" ") if self.spaceless else self.words.findall(text)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null. The strings of special tokens become their ids."""
        if not text:
            return []
        parts = self._special.split(text) if self._special and any(s in text for s in self.special) else [text]
        if len(parts) > 1:
            return list(chain.from_iterable((self.special[p],) if p in self.special else self._encode_part(p) for p in parts if p))
        return self._encode_part(text)

    def _encode_part(self, text: str) -> list[int]:
        if not self.spaceless and self.normalizers:
            return list(self._encode_run(text))
        return list(chain.from_iterable(map(self.memo.__getitem__, self._runs(text))))

    def _number_words(self, words: list[str]) -> None:
        """Encodes words that have no number yet."""
        new = self.met_words.new_among(words)
        raw = [w.encode("utf-8", "replace") for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= self.merges.lookahead]
        found = dict(zip(short, self.merges.apply_words([raw[i] for i in short])))
        self.met_words.add(new, [found[i] if i in found else self._encode_word(w) for i, w in enumerate(new)])

    def _normalised(self, text: str) -> str:
        for normalize in self.normalizers:
            text = normalize(text)
        return text

    def _number_runs(self, runs: list[bytes]) -> None:
        """Encodes runs between ASCII white space that have no number yet.

        Runs are normalised in one text, a space between two, only where none of them can lose or gain a space by that: they
        have no white space of their own, and the normalizers leave all else in its place. Any other run is normalised alone.
        """
        parts = [run.decode("utf-8") for run in runs]
        together = [i for i, part in enumerate(parts) if part.isascii() or not _ODD_SPACE.search(part)] if self.local else []
        alone = set(range(len(parts))).difference(together)
        for i, part in zip(together, self._normalised(" ".join([parts[i] for i in together])).split(" "), strict=True) if together else ():
            parts[i] = part
        for i in alone:
            parts[i] = self._normalised(parts[i])
        split = [[part] if part.isalpha() else self.words.findall(part) for part in parts]
        words = list(chain.from_iterable(split))
        self._number_words(words)
        flat, lengths = self.met_words.ids_of(words)
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        total = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        self.met_runs.add_flat(runs, flat, np.diff(total))

    def encode_many(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each UTF-8 text, as ``encode`` gives them; what a worker has met is not encoded again."""
        pieces: list[list] = []
        alone: dict[int, list[int]] = {}
        special = [s.encode() for s in self.special]
        for place, text in enumerate(texts):
            if text and ((self.normalizers and not self.spaceless) or any(s in text for s in special)):
                alone[place] = self.encode(text.decode("utf-8"))
                pieces.append([])
            elif self.spaceless:
                pieces.append((text or b"").split())
            else:
                pieces.append(self.words.findall((text or b"").decode("utf-8")))
        met, every = self.met_runs if self.spaceless else self.met_words, list(chain.from_iterable(pieces))
        if self.spaceless:
            self._number_runs(self.met_runs.new_among(every))
        else:
            self._number_words(every)
        flat, lengths = met.ids_of(every)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, pieces)])]
        return [np.array(alone[k], dtype=np.int32) if k in alone else flat[a:b] for k, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]

    def forget(self) -> None:
        """Gives back what is remembered between texts; a worker keeps the vocabulary only when its task ends."""
        self.memo.clear()
        self.word_memo.clear()
        self.met_runs, self.met_words = Met(), Met()

    def decoder(self) -> Decoder:
        return Decoder(self)

    def decode(self, ids: Iterable[int]) -> str:
        machine = self.decoder()
        return machine.feed(ids) + machine.finish()


_ASCII_SPACE = {c: " " for c in b"\t\n\x0b\x0c\r"}
#: White space in a run between ASCII white space, by the normalizers' rule or by Python's.
_ODD_SPACE = regex.compile(r"[\s\x1c-\x1f]")


class Decoder:
    """Text from ids that arrive bit by bit; what is held back is at most the bytes of one unfinished character.

    Without a decoder in the tokenizer file the tokens themselves are the text, one space between two; with a byte-level one
    their glyphs stand for bytes, and bytes that make no character become U+FFFD.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.started = tokenizer, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        tokens = self.tokenizer.tokens
        if self.tokenizer.byte_level_text:
            return self.machine.decode(b"".join(bytes(_BYTES[g] for g in tokens[i]) if i in tokens and all(g in _BYTES for g in tokens[i]) else tokens.get(i, "").encode() for i in ids))
        shown = " ".join([tokens[i] for i in ids if i in tokens])
        text = f" {shown}" if self.started and shown else shown
        self.started |= bool(shown)
        return text

    def finish(self) -> str:
        return self.machine.decode(b"", True) if self.tokenizer.byte_level_text else ""


_LOADED: dict[int, Tokenizer] = {}


def loaded(shared) -> Tokenizer:
    """The tokenizer of a broadcast description; each Python worker keeps the last one."""
    if (key := hash(shared.value)) not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(shared.value)
    return _LOADED[key]


#: A tokenizer file may have as many bytes at most; it is read by the driver and broadcast.
MOST_FILE_BYTES = 64 << 20


def shared_description(spark, path: str):
    with open(path, encoding="utf-8") as file:
        description = file.read(MOST_FILE_BYTES + 1)
    if len(description) > MOST_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MOST_FILE_BYTES} bytes")
    Tokenizer(description)  # refuses what isn't supported before any task starts
    return spark.sparkContext.broadcast(description)


def in_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``_ROWS`` rows and about ``_CHARS`` bytes of the text column."""
    sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
    first = size = 0
    for at, n in enumerate(sizes.tolist()):
        if at > first and (size + n > _CHARS or at - first >= _ROWS):
            yield batch.slice(first, at - first)
            first, size = at, 0
        size += n
    if batch.num_rows:
        yield batch.slice(first)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(id, ids array<int>, decoded string) per row of ``docs``, by the tokenizer file at ``path`` on the driver.

    Null and empty texts give an empty array and an empty string. Null ids and repeated rows are kept as they are; an empty
    table gives no rows; other columns are left out. ``decode=False`` leaves ``decoded`` null.
    """
    shared = shared_description(docs.sparkSession, path)

    def run(batches):
        tokenizer = loaded(shared)
        for whole in batches:
            for batch in in_parts(whole, 1):
                ids = tokenizer.encode_many(batch.column(1).cast(pa.binary()).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate([np.empty(0, dtype=np.int32), *ids]))
                texts = pa.array([tokenizer.decode(x.tolist()) for x in ids] if decode else [None] * len(ids), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat), texts], ["id", "ids", "decoded"])
        tokenizer.forget()

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {sql_type(docs, id_col)}, ids array<int>, decoded string")


def decode_ids(rows: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) per row of ``rows``; a null array gives a null text, an empty one an empty text."""
    shared = shared_description(rows.sparkSession, path)

    def run(batches):
        tokenizer = loaded(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = [None if x is None else tokenizer.decode(i for i in x if i is not None) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return map_arrow(rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")), run, f"id {sql_type(rows, id_col)}, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return encoded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe_encoding_and_decoding(spark, sf_dir):
    return digests(encode_texts(table(spark, sf_dir, "documents"), word_tokenizer_path()))


QUERIES = {"op9_bpe_encoding_and_decoding": op9_bpe_encoding_and_decoding}
ORACLE_SQL: dict[str, str] = {}
