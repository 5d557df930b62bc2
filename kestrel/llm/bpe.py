"""Operator 6: byte-pair encoding by speculate-and-verify, and decoding.

Method.  The words of a text are cut as the vocabulary's tokenizer cuts them.  Each distinct
word is first segmented greedily: the longest vocabulary entry at each position, found by a
trie walk done for all words at once.  A segmentation is the one that merging would give if
(a) every token is what merging makes of its own bytes and (b) no merge can cross the border of
any adjacent pair; (b) is tested for all distinct pairs at once on the borders' merge spines.
Only words with a failing pair are merged exactly, in rank order, again many words at a time.

Defined results: a null or empty text has no ids and decodes to the empty string; the special
tokens' strings inside a text become their ids, as in the tokenizers library; texts of any
length are encoded whole; repeated rows give repeated results; an empty table an empty result.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kestrel.llm.common import byte_view, gather_lists, list_array, text_slices

END = "</w>"
#: Words over this many bytes are merged with a heap instead of in a padded matrix.
LONG_WORD = 256
# The pattern by which this kind of vocabulary cuts words.
PIECES = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Distinct words whose ids a process remembers; the memory is emptied when full.
CACHED_WORDS = 400_000
#: Chunks with other characters than these go through the library's own normaliser and splitter.
ODD = "[^\\x20-\\x7e¡-įı-ɏ]|<\\|"
LETTERS = r"^\pL+$"
EMPTY = np.uint32(0xFFFFFFFF)


class PairTable:
    """uint32 keys to int32 values in an open-addressing table, looked up many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        size = 1 << self.bits
        self.keys = np.full(size, EMPTY, np.uint32)
        self.values = np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):
            free = self.keys[slot] == EMPTY
            _, first = np.unique(slot[free], return_index=True)
            put = np.nonzero(free)[0][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where absent."""
        keys = keys.astype(np.uint32, copy=False)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        open_ = np.nonzero((found != keys) & (found != EMPTY))[0]
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != EMPTY)]
        return out


def _as_bytes(words: pa.Array) -> list[bytes]:
    """The words as Python bytes; none holds a line feed."""
    if not len(words):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"\n")
    return joined[0].as_py().split(b"\n")


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + n)
    return [chars[b] for b in range(256)]


class WordBpe:
    """A word-end byte-pair vocabulary (``tokenizers`` JSON file), ids below 65,536."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        if spec["model"].get("end_of_word_suffix") != END or max(vocab.values()) >= 65535:
            raise ValueError("a vocabulary with word ends and ids below 65,535 is needed")
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        chars = _byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + END] for c in chars], np.int32)
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * n
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.token_strings = pa.array(self.strings, pa.string())
        left = np.array([vocab[a] for a, _ in merges], np.int32)
        right = np.array([vocab[b] for _, b in merges], np.int32)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make the same token")
        self.rank = np.full(n, -1, np.int64)           # by the token a merge makes
        self.rank[made] = np.arange(len(made))
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.left[made], self.right[made] = left, right
        self.merges = PairTable(_pair(left, right), made)
        self._build_trie(vocab)
        stable = np.zeros(n, bool)
        words = [(self._bytes(s), i) for s, i in vocab.items()]
        ids = np.array([i for _, i in words])
        raw, at = byte_view(pa.array([w for (w, _), _ in words], pa.binary()))
        flat, starts = self._exact(raw, at, np.arange(len(words)), np.array([e for (_, e), _ in words]))
        alone = np.diff(starts) == 1
        stable[ids[alone]] = flat[starts[:-1][alone]] == ids[alone]
        self.stable = stable
        self.known: dict[bytes, int] = {}
        self.known_ids, self.known_starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # -- tables ---------------------------------------------------------------------------

    def _bytes(self, token: str) -> tuple[bytes, bool]:
        """Bytes of a token and whether it ends a word."""
        ends = token.endswith(END) and token != END
        body = token[:-len(END)] if ends else token
        return bytes(self.byte_of[c] for c in body), ends

    def _build_trie(self, vocab: dict[str, int]) -> None:
        """Children by (node, symbol); a symbol is a byte, plus 256 on a word's last byte."""
        node_of: dict[tuple[int, int], int] = {}
        token_at = [-1]
        for s, i in vocab.items():
            body, ends = self._bytes(s)
            node = 0
            for at, b in enumerate(body):
                sym = b + 256 * (ends and at == len(body) - 1)
                nxt = node_of.get((node, sym))
                if nxt is None:
                    nxt = node_of[(node, sym)] = len(token_at)
                    token_at.append(-1)
                node = nxt
            token_at[node] = i
        if len(token_at) >= 1 << 22:
            raise ValueError("vocabulary too large")
        keys = np.array([(a << 9) | s for a, s in node_of], np.uint32)
        self.child = PairTable(keys, np.array(list(node_of.values()), np.int32))
        self.token_at = np.array(token_at, np.int32)

    # -- exact merging --------------------------------------------------------------------

    def _exact(self, raw: np.ndarray, starts: np.ndarray, rows: np.ndarray,
               word_ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Merge the words ``raw[starts[i]:starts[i + 1]]`` for ``i`` in ``rows`` in rank order, leftmost first.

        ``word_ends`` False: the word has no word end (vocabulary entries only).
        """
        begin, lens = starts[:-1][rows], np.diff(starts)[rows]
        order = np.argsort(lens, kind="stable")
        by_size = lens[order]
        flats, owners = [], []
        at = 0
        while at < len(order):
            if by_size[at] > LONG_WORD:
                i = order[at]
                flats.append(self._exact_long(raw[begin[i]: begin[i] + lens[i]].tobytes(), word_ends is None or bool(word_ends[i])))
                owners.append(np.full(len(flats[-1]), i))
                at += 1
                continue
            limit = min(LONG_WORD, max(4, int(by_size[at]) * 5 // 4))
            stop = min(int(np.searchsorted(by_size, limit, side="right")), at + max(1, (1 << 20) // limit))
            group = order[at:stop]
            cols = np.arange(int(by_size[stop - 1]))
            inside = cols[None, :] < lens[group][:, None]
            byte = raw[np.where(inside, begin[group][:, None] + cols[None, :], 0)]
            final = cols[None, :] == lens[group][:, None] - 1
            if word_ends is not None:
                final &= word_ends[group][:, None]
            sym = np.where(inside, np.where(final, self.last[byte], self.inner[byte]), np.int32(-1))
            done, size = self._merge_matrix(sym, lens[group].copy())
            flats.append(done[cols[None, :] < size[:, None]])
            owners.append(np.repeat(group, size))
            at = stop
        if not flats:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        flat, owner = np.concatenate(flats), np.concatenate(owners)
        out = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(np.bincount(owner, minlength=len(rows)), out=out[1:])
        return flat[np.argsort(owner, kind="stable")], out

    def _merge_matrix(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One merge of lowest rank per row and round, on rows padded with -1."""
        rows, width = sym.shape
        none = np.int32(2 ** 31 - 1)
        if width < 2:
            return sym, size
        made = self.merges.get(_pair(np.maximum(sym[:, :-1], 0), np.maximum(sym[:, 1:], 0)).ravel()).reshape(rows, width - 1)
        # A merge's rank grows with the id it makes only if ids follow ranks; keep ranks themselves.
        rank = np.where((made >= 0) & (sym[:, 1:] >= 0), self.rank[made].astype(np.int32), none)
        live = np.arange(rows)
        cols = np.arange(width)
        while len(live):
            r = rank[live]
            j = r.argmin(axis=1)
            low = r[np.arange(len(live)), j]
            go = low != none
            live, j = live[go], j[go]
            if not len(live):
                break
            s = sym[live]
            at = np.arange(len(live))
            s[at, j] = self.merges.get(_pair(s[at, j], s[at, j + 1]))
            src = np.minimum(cols[None, :] + (cols[None, :] > j[:, None]), width - 1)
            s = np.take_along_axis(s, src, axis=1)
            s[:, -1] = -1
            rk = np.take_along_axis(np.concatenate([rank[live], np.full((len(live), 1), none)], axis=1), src, axis=1)[:, :-1]
            rk[:, -1] = none
            for k, ok in ((j - 1, j > 0), (j, j < width - 1)):
                x, q = at[ok], k[ok]
                a, b = s[x, q], s[x, q + 1]
                m = self.merges.get(_pair(np.maximum(a, 0), np.maximum(b, 0)))
                rk[x, q] = np.where((m >= 0) & (a >= 0) & (b >= 0), self.rank[m].astype(np.int32), none)
            sym[live], rank[live] = s, rk
            size[live] -= 1
        return sym, size

    def _exact_long(self, word: bytes, ends: bool) -> np.ndarray:
        """The same for one long word, with a heap of (rank, position) over a linked list."""
        sym = self.inner[np.frombuffer(word, np.uint8)].tolist()
        if ends:
            sym[-1] = int(self.last[word[-1]])
        n = len(sym)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.merges.get(_pair(np.array(sym[:-1], np.int32), np.array(sym[1:], np.int32)))
        heap = [(int(self.rank[m]), i, int(m), sym[i], sym[i + 1]) for i, m in enumerate(first) if m >= 0]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and nxt[i] < n:
                m = int(self.merges.get(_pair(np.array([sym[i]]), np.array([sym[nxt[i]]])))[0])
                if m >= 0:
                    heapq.heappush(heap, (int(self.rank[m]), i, m, sym[i], sym[nxt[i]]))

        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            if sym[i] != a or nxt[i] >= n or sym[nxt[i]] != b:
                continue
            gone = nxt[i]
            sym[i], sym[gone], nxt[i] = m, -1, nxt[gone]
            if nxt[i] < n:
                prev[nxt[i]] = i
            push(prev[i])
            push(i)
        return np.array([s for s in sym if s >= 0], np.int32)

    # -- speculation and verification -----------------------------------------------------

    def _greedy(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest vocabulary entry at each position of each word, all words at once."""
        n = len(starts) - 1
        sym = raw.astype(np.uint32)
        sym[starts[1:] - 1] += 256
        pos, end = starts[:-1].copy(), starts[1:]       # pos: where the current token starts
        at, node = pos.copy(), np.zeros(n, np.uint32)
        best, best_end = np.full(n, -1, np.int32), pos.copy()
        live = np.arange(n)
        words, tokens = [], []
        while len(live):
            inside = at[live] < end[live]
            step = live[inside]
            nxt = self.child.get((node[step] << np.uint32(9)) | sym[at[step]])
            went = nxt >= 0
            moved = step[went]
            node[moved] = nxt[went]
            at[moved] += 1
            token = self.token_at[nxt[went]]
            hit = token >= 0
            best[moved[hit]], best_end[moved[hit]] = token[hit], at[moved[hit]]
            stuck = np.concatenate([step[~went], live[~inside]])
            if len(stuck):
                words.append(stuck)
                tokens.append(best[stuck])              # every byte is an entry: best is set
                pos[stuck] = best_end[stuck]
                at[stuck], node[stuck], best[stuck] = pos[stuck], 0, -1
                live = live[pos[live] < end[live]]
        if not words:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        word, token = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        out = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(word, minlength=n), out=out[1:])
        return token[order], out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of a·b.

        A merge (x, y) crosses if x lies on a's right spine, y on b's left spine, and both still
        stand when its rank comes up: neither has been taken into its parent by then.  At equal
        rank the left merge is done first.
        """
        ok = np.ones(len(a), bool)
        never = np.int64(2 ** 62)
        live = np.arange(len(a))
        x, x_gone = a.astype(np.int64), np.full(len(a), never)
        while len(live):
            y, y_gone = b[live].astype(np.int64), np.full(len(live), never)
            inner = np.arange(len(live))
            while len(inner):
                i = live[inner]
                m = self.merges.get(_pair(x[i], y[inner]))
                rank = np.where(m >= 0, self.rank[m], never)
                bad = (m >= 0) & (rank < x_gone[i]) & (rank <= y_gone[inner])
                ok[i[bad]] = False
                inner = inner[~bad]
                down = self.left[y[inner]] >= 0
                inner = inner[down]
                y_gone[inner] = self.rank[y[inner]]
                y[inner] = self.left[y[inner]]
            live = live[ok[live]]
            live = live[self.right[x[live]] >= 0]
            x_gone[live] = self.rank[x[live]]
            x[live] = self.right[x[live]]
        return ok

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word (binary array, no empties), concatenated, with their starts."""
        raw, starts = byte_view(words)
        tokens, out = self._greedy(raw, starts)
        good = np.ones(len(words), bool)
        owner = np.repeat(np.arange(len(words)), np.diff(out))
        good[owner[~self.stable[tokens]]] = False
        same = owner[1:] == owner[:-1]
        keys = _pair(tokens[:-1][same], tokens[1:][same])
        distinct, where = np.unique(keys, return_inverse=True)
        fine = self.compatible((distinct >> np.uint32(16)).astype(np.int32), (distinct & np.uint32(65535)).astype(np.int32))
        good[owner[1:][same][~fine[where]]] = False
        failing = np.nonzero(~good)[0]
        if not len(failing):
            return tokens, out
        mended, m_starts = self._exact(raw, starts, failing)
        source = np.concatenate([tokens, mended])
        lens = np.diff(out)
        begin = out[:-1].copy()
        lens[failing], begin[failing] = np.diff(m_starts), m_starts[:-1] + len(tokens)
        new = np.zeros(len(words) + 1, np.int64)
        np.cumsum(lens, out=new[1:])
        index = np.repeat(begin - new[:-1], lens) + np.arange(new[-1])
        return source[index], new

    # -- texts ----------------------------------------------------------------------------

    def _odd_pieces(self, chunk: str) -> list[bytes]:
        """Pieces of a chunk by the library's own normaliser and splitter; specials as 0xFF + name."""
        out = []
        for part in self.special_re.split(chunk):
            if part in self.special:
                out.append(b"\xff" + part.encode())
            elif part:
                pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))
                out += [bytes(self.byte_of[c] for c in p) for p, _ in pieces if p]
        return out

    def _chunk_pieces(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of the chunks (binary) and the starts of each chunk's.

        Chunks of Latin letters only are one piece; other plain chunks go through the pattern.
        """
        odd = pc.match_substring_regex(chunks, ODD).to_numpy(zero_copy_only=False)
        alone = pc.match_substring_regex(chunks, LETTERS).to_numpy(zero_copy_only=False) & ~odd
        rows = np.nonzero(~odd & ~alone)[0]
        text = pc.utf8_lower(chunks.filter(pa.array(~odd & ~alone)))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text), "\n")[0].as_py()
        cut = pa.array(PIECES.findall(text), pa.string()).cast(pa.binary())
        raw, starts = byte_view(cut)
        line = np.diff(starts) == 1
        line[line] = raw[starts[:-1][line]] == 10
        owners, parts = [np.nonzero(alone)[0]], [pc.utf8_lower(chunks.filter(pa.array(alone))).cast(pa.binary())]
        owners.append(rows[np.cumsum(line)[~line]] if len(rows) else rows)
        parts.append(cut.filter(pa.array(~line)))
        if odd.any():
            pieces = [self._odd_pieces(c) for c in chunks.filter(pa.array(odd)).to_pylist()]
            owners.append(np.repeat(np.nonzero(odd)[0], [len(p) for p in pieces]))
            parts.append(pa.array([p for x in pieces for p in x], pa.binary()))
        owner = np.concatenate(owners)
        out = np.zeros(len(chunks) + 1, np.int64)
        np.cumsum(np.bincount(owner, minlength=len(chunks)), out=out[1:])
        return pa.concat_arrays(parts).take(pa.array(np.argsort(owner, kind="stable"))), out

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (null: empty), concatenated, with their ``n + 1`` starts."""
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        if not len(flat.dictionary):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        pieces, piece_starts = self._chunk_pieces(flat.dictionary)
        coded = pieces.dictionary_encode()
        ids, id_starts = self._encode_distinct(coded.dictionary)
        # pieces -> chunks -> texts
        chunk_ids, at = gather_lists(ids, id_starts, coded.indices.to_numpy(zero_copy_only=False))
        out, ends = gather_lists(chunk_ids, at[piece_starts], codes)
        return out, ends[offsets - offsets[0]]

    def _encode_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words; words met before in this process come from a cache of bounded size."""
        if len(self.known) + len(words) > CACHED_WORDS:
            self.known, self.known_ids, self.known_starts = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        plain = _as_bytes(words)
        at = np.fromiter(map(self.known.get, plain, repeat(-1)), np.int64, len(plain))
        new = np.nonzero(at < 0)[0]
        if len(new):
            ids, starts = self._encode_new(words.take(pa.array(new)))
            if len(new) > CACHED_WORDS:
                return ids, starts          # only without any cached word: the cache was just emptied
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(map(plain.__getitem__, new.tolist()), at[new].tolist()))
            self.known_starts = np.concatenate([self.known_starts, starts[1:] + len(self.known_ids)])
            self.known_ids = np.concatenate([self.known_ids, ids])
        return gather_lists(self.known_ids, self.known_starts, at)

    def _encode_new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        special = np.nonzero(pc.starts_with(words, b"\xff").to_numpy(zero_copy_only=False))[0]
        if not len(special):
            return self.encode_words(words)
        stand_in = words.to_pylist()
        ids = [self.special[stand_in[i][1:].decode()] for i in special]
        for i in special:
            stand_in[i] = b"!"
        flat, starts = self.encode_words(pa.array(stand_in, pa.binary()))
        flat = flat.copy()
        flat[starts[special]] = ids
        return flat, starts

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """Texts of the id lists: the vocabulary's strings with a space between, special ones kept."""
        tokens = self.token_strings.take(pa.array(ids, pa.int32()))
        return pc.binary_join(list_array(tokens, starts), " ")


@lru_cache(maxsize=2)
def load_bpe(path: str) -> WordBpe:
    """The vocabulary, built once per worker process."""
    return WordBpe(path)


DIGEST_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_documents(docs: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text."""
    def run(batches):
        bpe = load_bpe(vocab_path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, starts = bpe.encode_texts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), list_array(pa.array(ids, pa.int32()), starts)], ["doc_id", "ids"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a null list decodes to the empty text."""
    def run(batches):
        bpe = load_bpe(vocab_path)
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), pa.scalar([], batch.column("ids").type))
            starts = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)[starts[0]: starts[-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bpe.decode(ids, starts - starts[0])], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Encode and decode every whole text; counts and SHA-256 digests of the ids and the decoded text."""
    def run(batches):
        bpe = load_bpe(vocab_path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, starts = bpe.encode_texts(part.column("text"))
                wide = ids.astype("<u4")
                id_sha = [hashlib.sha256(wide[a:b]).hexdigest() for a, b in zip(starts[:-1], starts[1:])]
                text, at = byte_view(bpe.decode(ids, starts))
                text_sha = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(starts)), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())],
                    DIGEST_SCHEMA.names)
    return docs.select("doc_id", "text").mapInArrow(run, DIGEST_SCHEMA)
