"""Byte-pair encoding by white-space chunk, with a dynamic program over prefixes.

A sequence of tokens is the encoding of its text exactly when every neighbouring pair is
the encoding of the pair's own text.  So the last token of each prefix is the one vocabulary
entry that ends there and is compatible with the last token of the shorter prefix it leaves,
and one pass over a word gives the token count of each of its prefixes.  Where counts are
wanted, new words are taken in order, and what a word shares with the one before it is not
walked again.  Where ids are wanted, a rank-merging encoder proposes those of all new words in one
call, and each distinct pair of neighbours among them is proved once.  Words are solved once per
worker; a document is then a gather from the word table.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks in one worker's table; beyond it, those used once only are forgotten.
MAX_CHUNKS = 500_000
#: Pre-tokens kept besides, for chunks that differ in punctuation alone.
MAX_WORDS = 50_000
#: Stands for the word end in the rank-merging encoder; no word has white space in it.
END_BYTE = b"\n"
#: Text bytes encoded in one numpy step.
STEP_BYTES = 8 << 20


class Room(NamedTuple):
    """What a worker holds while it encodes: chunks in its table, text bytes of a numpy step, rows of an Arrow batch."""

    chunks: int
    step_bytes: int
    rows: int


#: For a job of its own, and for one whose executors carry the memory of other operators' stages.
ALONE, SHARED = Room(MAX_CHUNKS, STEP_BYTES, 5_000), Room(350_000, 1 << 20, 1_000)
#: Text whose characters stay in NFC and are each one in lower case.
LATIN = regex.compile(r"[\0-~À-ÿ]*")
#: White space as the tokenizer's pattern has it.
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class WordBPE:
    """A lower-casing, white-space-dropping BPE model with word ends, read from its tokenizer file."""

    #: Chunks in the table, where not ``MAX_CHUNKS``.
    most: int | None = None

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a lower-casing BPE with word ends")
        self.path = path
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.made = self.splits()
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.special = sorted({t["content"][:2] for t in spec.get("added_tokens", [])})
        strings = sorted((t["content"] for t in spec.get("added_tokens", [])), key=lambda x: (-len(x), x))
        self.controls = regex.compile("|".join(map(regex.escape, strings)) or r"(?!)")
        self.symbols = byte_symbols()
        self.longest = max(len(t) - len(self.end) * t.endswith(self.end) for t in self.vocab)
        self.fits: dict[tuple[str, str], bool] = {}
        self.opens = {t for t in self.vocab if not t.endswith(self.end)}
        self.closes = {t.removesuffix(self.end) for t in self.vocab if t.endswith(self.end)}
        self.follow: dict[str, tuple[dict[str, bool], dict[str, bool]]] = {"": ({}, {})}
        self.followed = 0
        self.token_of_id = {i: t for t, i in self.vocab.items()}
        self.ranked, self.id_of_rank, self.ends = self.rank_encoder()

    @functools.cached_property
    def library(self):
        """The library's own tokenizer, loaded when an odd chunk first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def rank_encoder(self):
        """A fast encoder that merges by rank alone; what it proposes is checked pair by pair."""
        import tiktoken

        byte_of = {c: b for b, c in enumerate(self.symbols)}
        raw = lambda t: bytes(byte_of[c] for c in t.removesuffix(self.end)) + END_BYTE * t.endswith(self.end)
        order = [c for c in self.symbols] + [c + self.end for c in self.symbols] + [a + b for a, b in self.ranks]
        ranks, ids = {END_BYTE: 0}, [-1]  # -1: no token
        for t in order:
            if t in self.vocab and self.symbols[END_BYTE[0]] not in t and ranks.setdefault(raw(t), len(ids)) == len(ids):
                ids.append(self.vocab[t])
        ranks |= {bytes([b]): len(ids) + b for b in range(256) if bytes([b]) not in ranks}
        ids += [-1] * 256
        ends = np.zeros(len(ids), bool)
        ends[[r for t, r in ranks.items() if t.endswith(END_BYTE)]] = True
        return tiktoken.Encoding("ranks", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={}), np.array(ids), ends

    def splits(self) -> dict[str, tuple[int, str, str]] | None:
        """The merge that makes each token, if each is made by one merge alone and after the merges of its parts."""
        made: dict[str, tuple[int, str, str]] = {}
        for (a, b), rank in self.ranks.items():
            if a + b in made or any(len(x.removesuffix(self.end)) > 1 and x not in made for x in (a, b)):
                return None
            made[a + b] = rank, a, b
        return made

    # -- words ---------------------------------------------------------------

    def merged(self, parts: list[str]) -> list[str]:
        """Apply the merges to a short list of symbols."""
        ranks, far = self.ranks, len(self.ranks)
        while len(parts) > 1:
            best, a, b = min((ranks.get((x, y), far), x, y) for x, y in zip(parts, parts[1:]))
            if best == far:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def atoms(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def stands(self, left: str, right: str) -> bool:
        """Whether the merges make ``left right`` of its text; without ``left``, ``right`` alone."""
        if self.made is None or not left:
            return self.merged(self.atoms(left) + self.atoms(right)) == ([left, right] if left else [right])
        for t, closing in ((left, False), (right, right.endswith(self.end) and right != self.end)):
            if not self.follows("", t.removesuffix(self.end) if closing else t, closing):
                return False
        # The merges of either side in reverse, the last one first: before none of them may one across the border have come.
        ranks, made, bound = self.ranks, self.made, len(self.ranks)
        none = (-1, "", "")
        while True:
            if ranks.get((left, right), bound) < bound:
                return False
            a, b = made.get(left, none), made.get(right, none)
            if a[0] > b[0]:
                bound, left = a[0], a[2]
            elif b[0] >= 0:
                bound, right = b[0] + 1, b[1]  # at equal rank the pair further left is merged first
            else:
                return True

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``left right`` is the encoding of its own text (left may be empty)."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[left, right] = self.stands(left, right)
        return known

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pre-tokens, end to end, and the number of each: as a rank-merging encoder proposes them, where all pairs of neighbours prove them."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ranks = self.ranked.encode_to_numpy("\n".join(words) + "\n", disallowed_special=())
        ids, ends = self.id_of_rank[ranks], self.ends[ranks]
        stops = np.flatnonzero(ends) + 1
        token, compatible = self.token_of_id, self.compatible
        alone, which = np.unique(ids, return_inverse=True)
        good = np.fromiter((i >= 0 and compatible("", token[i]) for i in alone.tolist()), bool, len(alone))[which]
        inner = np.flatnonzero(~ends)
        inner = inner[good[inner] & good[inner + 1]]
        size = int(ids.max()) + 1
        pairs, which = np.unique(ids[inner] * size + ids[inner + 1], return_inverse=True)
        good[inner] = np.fromiter((compatible(token[p // size], token[p % size]) for p in pairs.tolist()), bool, len(pairs))[which]
        lens = np.diff(stops, prepend=0)
        bad = np.unique(np.searchsorted(stops, np.flatnonzero(~good), "right")).tolist()
        if bad:
            parts, at = [], 0
            solved = {w: self.solve(w)[0] for w in {words[k] for k in bad}}
            for k in bad:
                own = solved[words[k]]
                parts += [ids[at : stops[k] - lens[k]], np.array(own, np.int64)]
                at, lens[k] = stops[k], len(own)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, lens

    def solve(self, word: str) -> tuple[list[int], list[int]]:
        """Token ids of one pre-token, and the token count of each of its code-point prefixes."""
        raw = word.encode()
        s = word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, raw))
        n, vocab, end, longest, fits, compatible = len(s), self.vocab, self.end, self.longest, self.fits, self.compatible
        last, count, back = [""] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        counts = []
        close = 0
        for j in range(1, n + 1):
            low = j - longest if j > longest else 0
            guess = back[j - 1]
            if j == n or raw[j] & 0xC0 != 0x80:
                # The closing token mostly starts where the last open one does, or where the last closing one did.
                for i in (guess, close, *range(j - 1, low - 1, -1)):
                    t = s[i:j] + end
                    if t in vocab and (i == 0 or last[i]):
                        pair = (last[i], t)
                        ok = fits.get(pair)
                        if compatible(*pair) if ok is None else ok:
                            close = i
                            counts.append(count[i] + 1)
                            break
                else:
                    raise ValueError(f"no token closes {word[:40]!r} at {j}")
            if j < n:
                for i in (guess, j - 1, *range(low, j - 1)):
                    t = s[i:j]
                    if t in vocab and (i == 0 or last[i]):
                        pair = (last[i], t)
                        ok = fits.get(pair)
                        if compatible(*pair) if ok is None else ok:
                            last[j], count[j], back[j] = t, count[i] + 1, i
                            break
        i, ids = close, [vocab[s[close:n] + end]]
        while i:
            ids.append(vocab[last[i]])
            i = back[i]
        return ids[::-1], counts

    def follows(self, left: str, right: str, closing: bool) -> bool:
        """Whether ``right``, at a word's end if ``closing``, may stand after ``left``; kept in ``follow`` by ``left``."""
        known = self.follow[left][closing]
        ok = known.get(right)
        if ok is None:
            ok = known[right] = self.stands(left, right + self.end if closing else right)
            self.followed += 1
        return ok

    def solve_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """The token count of each code-point prefix of each of ``words``, which come sorted.

        The state of a prefix depends on it alone, so a word goes on from where it leaves the word before.
        """
        if self.followed > 2_000_000:
            self.follow, self.followed = {"": ({}, {})}, 0
        opens, closes, follow, follows, longest = self.opens, self.closes, self.follow, self.follows, self.longest
        # Of each open prefix, by its length in bytes: where its last token begins, its tokens, that token, and what is known to follow it.
        back, count, last, then = [0], [0], [""], [follow[""]]
        closed: list[int] = []  # of each prefix in code points: its tokens if the word ends there
        before = ""
        for word in words:
            k = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                k += 1
            before = word
            del closed[k:]
            if word.isascii() and word.isprintable():
                s, raw, at = word, None, k
            else:
                raw = word.encode()
                s, at = "".join(map(self.symbols.__getitem__, raw)), len(word[:k].encode())
            n = len(s)
            del back[at + 1 :], count[at + 1 :], last[at + 1 :], then[at + 1 :]
            close = 0
            for j in range(at + 1, n + 1):
                p = j - 1
                if p == len(back):  # the open prefix before this place
                    i = back[p - 1]
                    t = s[i:p]
                    if not then[i][0].get(t):
                        for i in (i, p - 1, *range(max(0, p - longest), p - 1)):
                            t = s[i:p]
                            if t in opens and (i == 0 or last[i]):
                                ok = then[i][0].get(t)
                                if follows(last[i], t, False) if ok is None else ok:
                                    break
                        else:
                            i, t = p - 1, ""
                    back.append(i)
                    count.append(count[i] + 1)
                    last.append(t)
                    then.append(follow.get(t) or follow.setdefault(t, ({}, {})))
                if raw is None or j == n or raw[j] & 0xC0 != 0x80:
                    # The closing token mostly starts where the last open one does, or where the last closing one did.
                    i = back[p]
                    if not then[i][1].get(s[i:j]):
                        for i in (i, close, *range(p, max(0, j - longest) - 1, -1)):
                            t = s[i:j]
                            if t in closes and (i == 0 or last[i]):
                                ok = then[i][1].get(t)
                                if follows(last[i], t, True) if ok is None else ok:
                                    break
                        else:
                            raise ValueError(f"no token closes {word[:40]!r} at {j}")
                    close = i
                    closed.append(count[i] + 1)
            yield closed.copy()

    def solve_chunk(self, chunk: str, prefixes: bool) -> tuple[list[int], list[int]]:
        """The same for a chunk without white space."""
        lower = chunk.lower()
        plain = chunk.isascii() or (unicodedata.is_normalized("NFC", chunk) and len(lower) == len(chunk))
        if plain and not any(x in lower for x in self.special):
            ids: list[int] = []
            counts: list[int] = []
            for word in self.pattern.findall(lower):
                known = self.words.get(word)
                if known is None:
                    known = self.words[word] = self.solve(word) if prefixes else (self.encode_words([word])[0].tolist(), ())
                    if len(self.words) > MAX_WORDS:
                        self.words.clear()
                counts.extend([len(ids) + c for c in known[1]] if ids else known[1])
                ids.extend(known[0])
            if chunk.isascii() or self.is_latin(chunk) or ids == self.library.encode(chunk, add_special_tokens=False).ids:
                return ids, counts
        ids = self.library.encode(chunk, add_special_tokens=False).ids
        return ids, [*self.odd_prefixes(chunk)[:-1], len(ids)] if prefixes and chunk else []

    # -- chunks with special strings or characters that normalize --------------

    def odd_prefixes(self, chunk: str) -> list[int]:
        """Token counts at every prefix of a chunk with special strings or characters that normalize, in one pass.

        A special string counts once it is whole; until then its characters are ordinary text.
        """
        out: list[int] = []
        begun = done = 0  # where the ordinary text began, and the tokens before it
        for m in [*self.controls.finditer(chunk), None]:
            stop = m.end() - 1 if m else len(chunk)
            counts = self.normal_prefixes(chunk[begun:stop])
            out += [done + c for c in counts]
            if m:
                before = m.start() - begun
                done += (counts[before - 1] if before else 0) + 1
                out.append(done)
                begun = m.end()
        return out

    def normal_prefixes(self, text: str) -> list[int]:
        """Token counts at every prefix of a text without white space or special strings.

        Normalization works on pieces that nothing before them can join.  Where a prefix ends inside a piece and
        normalizes to something that the whole does not begin with, that end is counted from the state before the piece.
        """
        pieces = [m.group() for m in stable_pieces().finditer(text)]
        normal = [normalized(x) for x in pieces]
        walks, places = [], []
        for word in self.pattern.findall("".join(normal)):
            walks.append(Walk(self, word))
            places += [(len(walks) - 1, k) for k in range(len(word))]
        firsts = [0]
        for w in walks:
            firsts.append(firsts[-1] + w.closed[-1])

        def reached(at: int) -> int:
            """Tokens of the first ``at`` normalized characters."""
            if not at:
                return 0
            w, k = places[at - 1]
            return firsts[w] + walks[w].closed[k]

        out, at = [], 0
        for piece, whole in zip(pieces, normal):
            for k in range(1, len(piece) + 1):
                part = whole if k == len(piece) else normalized(piece[:k])
                if whole.startswith(part):
                    out.append(reached(at + len(part)))
                    continue
                w, k = places[at] if at < len(places) else (len(walks), 0)
                if k == 0 and w:  # the piece begins a word; without it the word before may go on
                    w, k = w - 1, len(walks[w - 1].word)
                context = walks[w].word[max(0, k - 64) : k] if walks else ""
                words = self.pattern.findall(context + part)
                if len(words[0]) > len(context):
                    tokens = firsts[w] + walks[w].with_tail(k, words[0][len(context) :]) if context else Walk(self, words[0]).closed[-1]
                else:
                    tokens = reached(at)
                out.append(tokens + sum(Walk(self, x).closed[-1] for x in words[1:]))
            at += len(whole)
        return out

    @staticmethod
    def is_latin(text: str) -> bool:
        return LATIN.fullmatch(text) is not None

    # -- batches -------------------------------------------------------------

    def start(self, prefixes: bool) -> None:
        """Make the table ready, of token counts at every prefix of a chunk or else of its token ids."""
        if getattr(self, "prefixes", None) is not prefixes:
            self.prefixes = prefixes
            self.words: dict[str, tuple[list[int], list[int]]] = {}
            self.index: dict[str, int] = {}
            self.data, self.at = array("I"), array("q", [0])
            self.used = np.zeros(0, np.int64)
        elif len(self.index) > (most := self.most or MAX_CHUNKS):
            keep = np.flatnonzero(self.used[: len(self.index)] > 1)[: most // 2]
            names = list(self.index)
            self.index = {names[r]: k for k, r in enumerate(keep)}
            kept, lens = gather(buffer(self.data), np.frombuffer(self.at, np.int64), keep)
            self.data = array("I", kept.tobytes())
            self.at = array("q", np.append(0, np.cumsum(lens)).astype(np.int64).tobytes())
            self.used = np.zeros(0, np.int64)

    def rows_of(self, chunks: list[str]) -> np.ndarray:
        """Table rows of distinct chunks, solving the new ones."""
        index, data, at = self.index, self.data, self.at
        rows = np.fromiter(map(index.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        places = np.flatnonzero(rows < 0)
        if len(places):
            new = [chunks[k] for k in places.tolist()]
            if self.prefixes:
                for own in self.new_counts(new):
                    data.extend(own)
                    at.append(len(data))
            else:
                flat, lens = self.new_ids(new)
                data.frombytes(flat.astype(np.uint32).tobytes())
                at.frombytes((at[-1] + np.cumsum(lens)).astype(np.int64).tobytes())
            rows[places] = np.arange(len(index), len(index) + len(new))
            index.update(zip(new, range(len(index), len(index) + len(new))))
        return rows

    def pretokens(self, chunk: str) -> list[str] | None:
        """The pre-tokens of a chunk of plain Latin text; None where the chunk is not, or may hold a special string."""
        if not (chunk.isascii() or self.is_latin(chunk)):
            return None
        lower = chunk.lower()
        return [lower] if lower.isalpha() else None if any(x in lower for x in self.special) else self.pattern.findall(lower)

    def new_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of ``chunks``, none of which is in the table, end to end, and the number of each."""
        split = [self.pretokens(chunk) for chunk in chunks]
        odd = [k for k, own in enumerate(split) if own is None]
        flat, lens = self.encode_words([word for own in split if own for word in own])
        lens = sums(lens, np.fromiter((len(own or ()) for own in split), np.int64, len(split)))
        if odd:
            stops, parts, at = np.cumsum(lens), [], 0
            for k in odd:
                own = self.solve_chunk(chunks[k], False)[0]
                parts += [flat[at : stops[k]], np.array(own, np.int64)]
                at, lens[k] = stops[k], len(own)
            flat = np.concatenate([*parts, flat[at:]])
        return flat, lens

    def new_counts(self, chunks: list[str]) -> Iterator[list[int]]:
        """The token counts at every prefix of each of ``chunks``, none of which is in the table."""
        index, data, at = self.index, self.data, self.at
        split: list[list[str] | None] = []  # pre-tokens of a chunk of plain Latin text
        words: dict[str, list[int]] = {}
        for chunk in chunks:
            own = self.pretokens(chunk)
            split.append(own)
            if own:
                for word in own:
                    row = index.get(word)
                    words[word] = [] if row is None else data[at[row] : at[row + 1]]
        todo = sorted(w for w, counts in words.items() if not counts)
        words.update(zip(todo, self.solve_sorted(todo)))
        for chunk, own in zip(chunks, split):
            if own is None:
                yield self.solve_chunk(chunk, True)[1]
            elif len(own) == 1:
                yield words[own[0]]
            else:
                counts: list[int] = []
                for word in own:
                    done = counts[-1] if counts else 0
                    counts += [done + c for c in words[word]]
                yield counts

    def chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The table row of each chunk of each text, and the number of chunks in each text."""
        plain = pc.match_substring_regex(texts, r"^[\t\n\r -~À-ÿ]*$")
        for x in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, x)))
        if pc.all(plain).as_py() is not False:
            lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        else:
            lower = pc.utf8_lower(texts).to_pylist()
            lists = pa.array([low.split() if ok else SPACE.split(raw) for ok, low, raw in zip(plain.to_pylist(), lower, texts.to_pylist())], pa.list_(pa.string()))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        rows = self.rows_of(coded.dictionary.to_pylist())
        if not len(rows):
            return np.empty(0, np.int64), sizes
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if len(self.used) < len(self.index):
            self.used = np.append(self.used, np.zeros(len(self.index) - len(self.used), np.int64))
        self.used[rows] += np.bincount(codes, minlength=len(rows))
        return rows[codes], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) of a batch of non-null texts, and the number of ids of each."""
        self.start(False)
        rows, sizes = self.chunked(texts)
        flat, lens = gather(buffer(self.data), np.frombuffer(self.at, np.int64), rows)
        return flat, sums(lens, sizes)

    def prefix_counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token count at every code-point prefix (flat uint32, from one code point on), and code points of each text."""
        self.start(True)
        rows, sizes = self.chunked(texts)
        within, lens = gather(buffer(self.data), np.frombuffer(self.at, np.int64), rows)
        totals = np.where(lens > 0, np.append(within, 0)[np.cumsum(lens) - 1], 0).astype(np.int64)
        begun = np.cumsum(totals) - totals  # tokens of the batch before each chunk
        firsts = np.cumsum(sizes) - sizes
        before = np.append(begun, totals.sum())[firsts]
        chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        solid = ~white(texts)
        at = np.repeat(begun.astype(np.int32), lens) + within.astype(np.int32)
        # Between chunks the count stands at what the last chunk reached; before a text's first one that is what stood before the text.
        seen = np.cumsum(solid, dtype=np.int32) - 1
        out = np.append(at, np.int32(0))[seen] - np.repeat(before.astype(np.int32), chars)
        np.maximum(out, 0, out=out)
        return out.astype(np.uint32), chars


class Walk:
    """The dynamic program over one pre-token, kept so that other ends can be tried at any place."""

    def __init__(self, bpe: WordBPE, word: str):
        self.bpe, self.word = bpe, word
        self.symbols = "".join(map(bpe.symbols.__getitem__, word.encode()))
        n = len(self.symbols)
        self.last, self.count = [""] * (n + 1), [0] * (n + 1)  # of the open prefix: its last token, its tokens
        self.stops = [0]
        for c in word:
            self.stops.append(self.stops[-1] + len(c.encode()))
        for j in range(1, n):
            self.last[j], self.count[j] = self.open(self.symbols, 0, j, self.last, self.count)
        self.closed = [self.close(self.symbols, 0, j, self.last, self.count) for j in self.stops[1:]]

    def open(self, s: str, base: int, j: int, last: list[str], count: list[int]) -> tuple[str, int]:
        """The last token and the tokens of the open prefix that ends at ``j``; ``base`` is what stands before ``s`` and its lists."""
        vocab = self.bpe.vocab
        for i in range(max(0, j - self.bpe.longest), j):
            t = s[i:j]
            if t in vocab and (base + i == 0 or last[i]) and self.bpe.compatible(last[i], t):
                return t, count[i] + 1
        return "", 0

    def close(self, s: str, base: int, j: int, last: list[str], count: list[int]) -> int:
        vocab = self.bpe.vocab
        for i in range(j - 1, max(0, j - self.bpe.longest) - 1, -1):
            t = s[i:j] + self.bpe.end
            if t in vocab and (base + i == 0 or last[i]) and self.bpe.compatible(last[i], t):
                return count[i] + 1
        raise ValueError(f"no token closes {self.word[:40]!r} at {j}")

    def with_tail(self, chars: int, tail: str) -> int:
        """Tokens of the word's first ``chars`` characters followed by ``tail``."""
        at = self.stops[chars]
        base = max(0, at - self.bpe.longest)
        s = self.symbols[base:at] + "".join(map(self.bpe.symbols.__getitem__, tail.encode()))
        last, count = self.last[base : at + 1], self.count[base : at + 1]
        if at == len(self.symbols) and at:  # the whole word was only closed, not left open
            last[-1], count[-1] = self.open(s, base, at - base, last, count)
        for j in range(at - base + 1, len(s)):
            more = self.open(s, base, j, last, count)
            last.append(more[0]), count.append(more[1])
        return self.close(s, base, len(s), last, count)


def normalized(text: str) -> str:
    """NFC and lower case, each character by itself."""
    return "".join(c.lower() for c in unicodedata.normalize("NFC", text))


@functools.lru_cache(maxsize=1)
def stable_pieces() -> regex.Pattern:
    """Finds pieces that begin with a character which joins nothing before it in NFC."""
    joining = {0x1160 + k for k in range(1, 0x16)} | {0x11A7 + k for k in range(1, 0x1C)}  # vowels and tails of Hangul
    for k in range(0x110000):
        two = unicodedata.decomposition(chr(k)).split()
        if unicodedata.combining(chr(k)):
            joining.add(k)
        if len(two) == 2 and not two[0].startswith("<"):
            joining.add(int(two[1], 16))
    some = "".join(f"\\U{k:08X}" for k in sorted(joining))
    return regex.compile(f"(?s).[{some}]*")


def buffer(data: array) -> np.ndarray:
    return np.frombuffer(data, np.uint32) if len(data) else np.empty(0, np.uint32)


def gather(data: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the slices ``data[at[r]:at[r + 1]]`` for each of ``rows``."""
    lens = at[rows + 1] - at[rows]
    stops = np.cumsum(lens)
    total = int(stops[-1]) if len(stops) else 0
    where = np.repeat(at[rows] - (stops - lens), lens)
    where += np.arange(total)
    return data[where] if total else np.empty(0, data.dtype), lens


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes."""
    total = np.append(0, np.cumsum(values))
    stops = np.cumsum(sizes)
    return total[stops] - total[stops - sizes]


def white(texts: pa.Array) -> np.ndarray:
    """For each code point of a batch, whether the tokenizer takes it for white space."""
    joined = b"".join(memoryview(x) for x in texts.cast(pa.binary()).to_pylist())
    raw = np.frombuffer(joined, np.uint8)
    if not len(raw):
        return np.zeros(0, bool)
    if raw.max() < 0xE1 and not (raw == 0xC2).any():
        heads = raw[(raw & 0xC0) != 0x80]
        return (heads == 32) | ((heads >= 9) & (heads <= 13))
    points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    odd = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    return (points == 32) | ((points >= 9) & (points <= 13)) | np.isin(points, np.array(odd, np.uint32))


@functools.lru_cache(maxsize=2)
def model(path: str) -> WordBPE:
    return WordBPE(path)


def steps(batch: pa.RecordBatch, column: str, step_bytes: int = STEP_BYTES):
    """Cut a batch into runs of rows of bounded text size; null texts become empty."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        done = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, done + step_bytes, "right")))
        yield batch.slice(at, stop - at), pa.concat_arrays([texts.slice(at, stop - at)])
        at = stop
