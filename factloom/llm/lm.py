"""N-gram language model as a weighted backoff automaton, counted and scored over the whole corpus in shards.

States are the contexts: all pairs of words that training holds, words, the start of a text, and the root, the empty context. A context has an arc for each
word that has followed it in training, and a failure arc to its longest shorter context that is a state; the root has an arc for every word and one for unknown
words. An arc leads to the longest context that ends in its word. Witten-Bell smoothing gives the weights: an arc (h, w) has
log10((c(h,w) + T(h) p(w | h')) / (c(h) + T(h))) and the failure arc log10(T(h) / (c(h) + T(h))), c being counts, T(h) the number of different followers of h,
h' the context that h fails to, and p(w) at the root the additive unigram distribution. A context never seen is no state.

A text is read once from left to right: the state is carried from word to word, and where it has no arc for a word its failure arcs are followed.

No task holds the whole model. Rows that are read one after another make a batch; each batch sends its distinct n-grams, once each, to shards by their first word, as a tree:
words, under them the words that follow, and under those the third ones, so that a pair is named once, as an n-gram and as a context. A shard adds up all batches' counts and
sends each batch the sums of just the n-grams that it asked for, in the order of asking; the batch, read again, builds the part of the automaton that its texts can reach and runs them through it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import documents, give_back, id_crc, small_batches, thrifty, written

#: Bytes of text of a batch of documents, in the mean; a shard has those of SHARE batches.
BATCH_BYTES, SHARE = 8 << 20, 2
#: A context that makes up one in HOT training tokens or more has what follows it spread over SLICES shards.
HOT, SLICES = 2_000, 16
#: Tokens of a block in which words and pairs are first counted.
BLOCK = 1 << 20
#: Words of a stretch of a text, which the automaton reads beside others.
STRETCH = 256
ALPHA = 0.1
#: Marks that no word can be, for they hold a space.
START, END = b" start", b" end"


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def _hashes(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A hash of pairs by their words' hashes (unsigned 64-bit, wrapping)."""
    h = (u ^ (v >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + v
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _sequences(texts: list[str | None], lower: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words by number, each text's numbers between those of START (0) and END (1) in one array, and how many each text has."""
    # marked in front, so that START and END are the first two, also without texts; few words at a time are Python's
    words, parts, lengths = [START, END], [], []
    for text in texts:
        found = words_of(text, lower)
        lengths.append(len(found) + 2)
        words += (START, *found, END)
        if len(words) >= 1 << 15:
            parts.append(pa.array(words, pa.binary()))
            words = []
    coded = pa.chunked_array([*parts, pa.array(words, pa.binary())]).dictionary_encode()
    seq = np.concatenate([c.indices.to_numpy() for c in coded.chunks])[2:].astype(np.int64)
    return coded.chunks[-1].dictionary.to_numpy(zero_copy_only=False).tolist(), seq, np.array(lengths, np.int64)


def _unique(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys (0 to bound - 1) in order and which one each is. Keys are sorted with their places in their low bits, where both fit in 63 bits."""
    bits = max(1, len(keys)).bit_length()
    if bound.bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys << bits | np.arange(len(keys)))
    key, place = both >> bits, both & (1 << bits) - 1
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    which = np.empty(len(key), np.int64)
    which[place] = np.cumsum(new) - 1
    return key[new], which


def _among(a: np.ndarray, few: np.ndarray) -> np.ndarray:
    """np.isin, for few values."""
    if not len(few):
        return np.zeros(len(a), bool)
    few = np.sort(few)
    return few[np.minimum(np.searchsorted(few, a), len(few) - 1)] == a


def _by_shard(shard: np.ndarray) -> np.ndarray:
    """A stable order by shard; numbers of 16 bits are sorted by radix."""
    return np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")


class Local:
    """The n-grams of a batch in an order that depends on the batch's texts alone, not on the order of its rows.

    Contexts are numbered: words first, by their hashes, then the pairs of the batch that may be states. An n-gram is context * words + word.
    """

    def __init__(self, texts: list[str | None], learned: np.ndarray, often: np.ndarray | None, lower: bool = True):
        ids, seq, self.lengths = _sequences(texts, lower)
        h = _hashes(ids)
        order = np.argsort(h, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hash, self.seq = h[order], rank[seq]
        self.n, self.start, self.end = len(h), int(rank[0]), int(rank[1])
        self.first = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)
        head = np.zeros(len(seq), bool)
        head[self.first] = True
        at = np.nonzero(~head)[0]
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths - 1)
        learns = np.asarray(learned, bool)[self.doc]
        self.w = self.seq[at]
        two, two_at = _unique(self.seq[at - 1] * self.n + self.w, self.n**2)
        #: for each word after the first of a text, which of the pairs it ends
        self.gram_at = two_at
        # the pairs among them that may be states, and the n-grams of three that go on from those
        pair_hash = _pair_hash(self.hash[two // self.n], self.hash[two % self.n])
        frequent = (two % self.n != self.end) & (True if often is None else _among(pair_hash, often))
        self.two = np.nonzero(frequent)[0]
        number = np.cumsum(frequent) - 1
        before = np.nonzero(frequent[two_at] & (self.w != self.end))[0]
        three, three_at = _unique((self.n + number[two_at[before]]) * self.n + self.w[before + 1], (self.n + len(self.two)) * self.n)
        # where each n-gram of three without its first word is among the pairs
        self.shorter = np.empty(len(three), np.int64)
        self.shorter[three_at] = two_at[before + 1]
        self.grams = np.concatenate((two, three))
        self.gram_count = np.concatenate((np.bincount(two_at, learns, len(two)), np.bincount(three_at, learns[before], len(three)))).astype(np.int64)
        self.contexts = np.concatenate((self.hash, pair_hash[frequent]))
        self.count = np.bincount(self.w, learns, self.n).astype(np.int64)
        self.count[self.start] = int(np.asarray(learned, bool).sum())

    def asked(self, shards: int, hot: np.ndarray):
        """For each shard that is asked: (shard, contexts, slice 0 or not, n-grams), both as indices in this batch's order."""
        slices = min(SLICES, shards)
        is_hot = _among(self.contexts, hot)
        home = (_middle(self.contexts) % np.uint64(shards)).astype(np.int64)
        ctx, word = self.grams // self.n, self.grams % self.n
        piece = np.where(is_hot[ctx], ((self.hash[word] >> np.uint64(32)) % np.uint64(slices)).astype(np.int64), 0)
        shard = (home[ctx] + piece) % shards
        by = _by_shard(shard)
        heads = np.nonzero(is_hot)[0]
        every = np.concatenate((np.arange(len(self.contexts)), np.repeat(heads, slices - 1)))
        of_slice = np.concatenate((np.zeros(len(self.contexts), np.int64), np.tile(np.arange(1, slices), len(heads))))
        every_shard = (home[every] + of_slice) % shards
        cby = np.lexsort((every, every_shard))
        # only shards that hold a context of the batch, however many there are
        found = np.unique(every_shard)
        edges, cedges = (np.stack((np.searchsorted(x, found), np.searchsorted(x, found, "right"))).T.tolist() for x in (shard[by], every_shard[cby]))
        for s, (a, b), (ca, cb) in zip(found.tolist(), edges, cedges, strict=True):
            c = cby[ca:cb]
            yield s, every[c], of_slice[c] == 0, by[a:b]


    def tree(self, shards: int, hot: np.ndarray):
        """For each shard that is asked: (shard, words, at home or not, pairs, own or not, n-grams of three), as indices in this batch's order; the pairs of a word, and what follows a pair, come in its order.

        A hot word's pairs are spread by their second word, and it is named in all slices; a hot pair's followers by the third, and it is named in all slices, under its word, without a count.
        """
        slices, n = min(SLICES, shards), self.n
        cut = np.searchsorted(self.grams, n * n)
        u, w = self.grams[:cut] // n, self.grams[:cut] % n
        three = self.grams[cut:]
        slice_of = ((self.hash >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)
        home, is_hot = (self.hash % np.uint64(shards)).astype(np.int64), _among(self.contexts, hot)
        at_two = (home[u] + np.where(is_hot[u], slice_of[w], 0)) % shards
        of = three // n
        parent = self.two[of - n]
        at_three = (at_two[parent] + np.where(is_hot[of], slice_of[three % n], 0)) % shards
        spread = lambda at, k: (np.repeat(at, slices - 1) + np.tile(np.arange(1, slices), k)) % shards
        hot_two, hot_one = self.two[is_hot[n:]], np.nonzero(is_hot[:n])[0]
        copies, at_copies = np.repeat(hot_two, slices - 1), spread(at_two[hot_two], len(hot_two))
        pairs, pair_at, own = np.concatenate((np.arange(cut), copies)), np.concatenate((at_two, at_copies)), np.arange(cut + len(copies)) < cut
        words = np.unique(np.concatenate((home * n + np.arange(n), spread(home[hot_one], len(hot_one)) * n + np.repeat(hot_one, slices - 1), at_copies * n + u[copies])))
        word_at, words = words // n, words % n
        by_two, by_three = np.argsort(pair_at * cut + pairs, kind="stable") if len(copies) else _by_shard(pair_at), _by_shard(at_three)
        pairs, pair_at, own, at_three = pairs[by_two], pair_at[by_two], own[by_two], at_three[by_three]
        # only shards that hold a word of the batch, however many there are
        found = np.unique(word_at)
        edges = [np.stack((np.searchsorted(x, found), np.searchsorted(x, found, "right"))).T.tolist() for x in (word_at, pair_at, at_three)]
        for s, (a, b), (c, d), (e, f) in zip(found.tolist(), *edges, strict=True):
            x, y, z = words[a:b], pairs[c:d], by_three[e:f]
            yield s, x, home[x] == s, y, own[c:d], z, np.bincount(np.searchsorted(x, u[y]), minlength=len(x)), np.bincount(np.searchsorted(y, parent[z]), minlength=len(y))


_PACK = zstandard.ZstdCompressor(level=1)


def _pack(a: np.ndarray) -> bytes:
    return _PACK.compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _middle(h: np.ndarray) -> np.ndarray:
    """The 40 bits of hashes that _forty sends."""
    return h >> np.uint64(12) & np.uint64((1 << 40) - 1)


def _forty(h: np.ndarray) -> np.ndarray:
    """The middle 40 bits of hashes, as five bytes each in planes: followers of one context differ by them."""
    return np.ascontiguousarray((h >> np.uint64(12)).view(np.uint8).reshape(-1, 8)[:, :5].T)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_TREE = ("ctx", "counts", "held", "followers", "pair_counts", "pair_held", "thirds", "third_counts")
_TREE_ASK = T.StructType([T.StructField("batch", T.LongType()), T.StructField("shard", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in _TREE)])
_TREE_ASK_ARROW = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), *((n, pa.binary()) for n in _TREE)])
_TREE_SUM = ("counts", "types", "pair_counts", "pair_types", "third_counts")
_TREE_SUMS = T.StructType([T.StructField("batch", T.LongType()), T.StructField("shard", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in _TREE_SUM), T.StructField("n", T.LongType()), T.StructField("v", T.LongType())])
_TREE_SUMS_ARROW = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), *((n, pa.binary()) for n in _TREE_SUM), ("n", pa.int64()), ("v", pa.int64())])
_BLOBS = T.StructType([T.StructField("batch", T.LongType()), T.StructField("rows", T.BinaryType())])


def _cut(batches, batch_bytes: int):
    """The rows of a partition in tables of about batch_bytes of text."""
    held, size = [], 0
    for b in batches:
        start = 0
        for i, x in enumerate(pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()):
            size += x + 1
            if size >= batch_bytes:
                yield pa.Table.from_batches([*held, b.slice(start, i + 1 - start)])
                held, size, start = [], 0, i + 1
        if start < b.num_rows:
            held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _named(table: pa.Table) -> int:
    """A name for a batch, by its rows and their order: rows that are the same are asked and answered alike."""
    h = xxhash.xxh64()
    for row in zip(*(table.column(n).to_pylist() for n in ("doc_id", "text", "learned")), strict=True):
        h.update(repr(row).encode("utf-8", "surrogatepass"))
    return h.intdigest() - (1 << 63)


def _asking_trees(shards: int, shared, batch_bytes: int):
    def ask(batches):
        hot, often = shared.value
        for table in _cut(batches, batch_bytes):
            batch, local, rows = _named(table), _local(table, often), []
            cut, follower = np.searchsorted(local.grams, local.n**2), lambda grams, h=local.hash, n=local.n: _forty(h[grams % n]).tobytes()
            for shard, words, home, pairs, own, thirds, held, pair_held in local.tree(shards, hot):
                two, three = local.grams[pairs], cut + thirds
                packed = (np.where(home, local.count[words], 0), held.astype(np.uint32), np.where(own, local.gram_count[pairs], 0), pair_held.astype(np.uint32), local.gram_count[three])
                counts, held, pair_counts, pair_held, third_counts = map(_pack, packed)
                rows.append((batch, shard, local.hash[words].tobytes(), counts, held, follower(two), pair_counts, pair_held, follower(local.grams[three]), third_counts))
            yield from _rows(rows, _TREE_ASK_ARROW).to_batches()
            del table, local, rows, follower
            give_back()

    return ask


def _under(owner: np.ndarray, held: np.ndarray, followers: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What followers (five bytes each, held of them under each owner in turn) sum up to: the owner of each different one, its sum, and which one each is."""
    f = []
    for x in followers:
        wide = np.zeros((len(x) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(x, np.uint8).reshape(5, -1).T
        f.append(wide.view(np.uint64).ravel())
    if owner.max(initial=0) >= 1 << 24:
        raise ValueError("too many contexts in a shard: make batches smaller")
    found, at = np.unique(np.repeat(owner, held).astype(np.uint64) << np.uint64(40) | np.concatenate(f), return_inverse=True)
    return (found >> np.uint64(40)).astype(np.int64), np.bincount(at, counts, len(found)).astype(np.int64), at


def _summing_trees(table: pa.Table) -> pa.Table:
    """Adds up a shard's trees over all batches and answers each batch in the order of its asking."""
    table = table.take(pa.array(np.argsort(table.column("batch").to_numpy(), kind="stable")))
    batches, shard = table.column("batch").to_pylist(), table.column("shard")[0].as_py()
    cols = {n: table.column(n).to_pylist() for n in _TREE}
    ctx = [np.frombuffer(x, np.uint64) for x in cols["ctx"]]
    held, pair_held = ([_unpack(x, np.uint32) for x in cols[n]] for n in ("held", "pair_held"))
    summed = lambda n: np.concatenate([_unpack(x, np.int64) for x in cols[n]])
    contexts, c_at = np.unique(np.concatenate(ctx), return_inverse=True)
    counts = np.bincount(c_at, summed("counts"), len(contexts)).astype(np.int64)
    owner, pairs, p_at = _under(c_at, np.concatenate(held), cols["followers"], summed("pair_counts"))
    types = np.bincount(owner[pairs > 0], minlength=len(contexts))
    owner, thirds, t_at = _under(p_at, np.concatenate(pair_held), cols["thirds"], summed("third_counts"))
    pair_types = np.bincount(owner[thirds > 0], minlength=len(pairs))
    words = counts[contexts != np.uint64(xxhash.xxh64_intdigest(START))]
    rows, c, p, t = [], 0, 0, 0
    for batch, x, y, z in zip(batches, ctx, held, pair_held, strict=True):
        a, b, d = c_at[c : c + len(x)], p_at[p : p + len(z)], t_at[t : t + int(z.sum())]
        c, p, t = c + len(a), p + len(b), t + len(d)
        rows.append((batch, shard, *map(_pack, (counts[a], types[a], pairs[b], pair_types[b], thirds[d])), 0, 0))
    rows[0] = (*rows[0][:7], int(words.sum()), int((words > 0).sum()))
    return _rows(rows, _TREE_SUMS_ARROW)


def _blobs(batch_bytes: int):
    """Batches of rows, each as one row, compressed."""

    def put(batches):
        for table in _cut(batches, batch_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(table.combine_chunks())
            yield pa.record_batch([pa.array([_named(table)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "rows"])

    return put


def _local(table: pa.Table, often: np.ndarray | None, lower: bool = True) -> Local:
    return Local(table.column("text").to_pylist(), table.column("learned").to_numpy(), often, lower)


class Automaton:
    """A weighted backoff automaton of any order over n words.

    Arcs are sorted keys (state * n + word) with weights and targets. Each state but the last, the root, has a failure arc (fail, failure); the root has an arc for every word.
    """

    def __init__(self, n: int, arcs: np.ndarray, weights: np.ndarray, targets: np.ndarray, fail: np.ndarray, failure: np.ndarray, root: np.ndarray, root_targets: np.ndarray):
        self.n, self.root_state = n, len(fail)
        self.arcs, self.weights, self.targets, self.fail, self.failure, self.root, self.root_targets = arcs, weights, targets, fail, failure, root, root_targets
        # a state's arcs lie together: where they begin, and how many they are
        self.many = np.bincount(arcs // n, minlength=self.root_state)
        self.begin = np.minimum(np.cumsum(self.many) - self.many, max(len(arcs) - 1, 0))

    def read(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log10 probability of one word for each state, and the states after it."""
        weight, after, left = np.zeros(len(states)), self.root_targets[words], np.arange(len(states))
        while len(left):
            s = states[left]
            down = s == self.root_state
            if down.any():
                weight[left[down]] += self.root[words[left[down]]]
                left, s = left[~down], s[~down]
            key = s * self.n + words[left]
            at, many = self.begin[s], self.many[s]
            own = self.arcs[at] == key if len(self.arcs) else np.zeros(len(key), bool)
            # most states have one arc; only among several one is searched for
            more = np.nonzero(~own & (many > 1))[0]
            if len(more):
                at[more] = np.minimum(np.searchsorted(self.arcs, key[more]), len(self.arcs) - 1)
                own[more] = self.arcs[at[more]] == key[more]
            weight[left[own]] += self.weights[at[own]]
            after[left[own]] = self.targets[at[own]]
            left, s = left[~own], s[~own]
            weight[left] += self.failure[s]
            states[left] = self.fail[s]
        return weight, after

    def scores(self, seq: np.ndarray, first: np.ndarray, lengths: np.ndarray, start: int, order: int = 3, stretch: int = STRETCH) -> np.ndarray:
        """Log10 probability of each text: seq[first + 1 :], of lengths - 1 words, read from the state start.

        Long texts are read in stretches side by side. The state after a word is the longest context that the text ends in there, which is order - 1 words at most;
        so a later stretch reads so many words before its own from the root, without their weights, and is in the state that the text has led to.
        All stretches of a batch take their k-th step together, each with the state that its words so far have led to.
        """
        before, stretch = order - 1, max(stretch, order - 1)
        pieces = np.maximum(1, -(-(lengths - 1) // stretch))
        of = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lead = np.where(nth > 0, before, 0)
        words = np.minimum(stretch, lengths[of] - 1 - nth * stretch) + lead
        begin = first[of] + 1 + nth * stretch - lead
        by = np.argsort(-words, kind="stable")
        words, begin, lead = words[by], begin[by], lead[by]
        states, out = np.where(lead > 0, self.root_state, start), np.zeros(len(by))
        going = np.searchsorted(-words, -np.arange(1, int(words.max(initial=0)) + 1), "right")
        for k, m in enumerate(going.tolist()):
            weight, states = self.read(states[:m], seq[begin[:m] + k])
            out[:m] += np.where(k < lead[:m], 0, weight) if k < before else weight
        return np.bincount(of[by], out, len(lengths))


def automaton(local: Local, least: int, total: int, distinct: int, count: np.ndarray, types: np.ndarray, gram_count: np.ndarray) -> tuple[Automaton, int]:
    """The part of the automaton that a batch can reach, from the corpus' sums, and the state that texts begin in; pairs counted least times or more are states."""
    n, m = local.n, len(local.two)
    root = np.log10((np.where(np.arange(n) == local.start, 0, count) + ALPHA) / (total + ALPHA * (distinct + 1)))
    held = np.concatenate((count, gram_count[local.two]))
    real = (types > 0) & np.concatenate((np.ones(n, bool), held[n:] >= least))
    mass, spared = np.where(real, held + types, 1), np.where(real, types, 1)
    kept = (gram_count > 0) & real[local.grams // n]
    some = np.nonzero(kept)[0]
    arcs, c = local.grams[some], gram_count[some]
    ctx, w = arcs // n, arcs % n
    words = ctx < n
    p, likely = np.empty(len(arcs)), 10.0**root
    p[words] = (c[words] + types[ctx[words]] * likely[w[words]]) / mass[ctx[words]]
    # a pair's arcs rest on those of its second word
    last = local.grams[local.two] % n
    pairs = len(local.grams) - len(local.shorter)
    up = (np.cumsum(kept[:pairs]) - 1)[local.shorter[some[~words] - pairs]]
    p[~words] = (c[~words] + types[ctx[~words]] * p[words][up]) / mass[ctx[~words]]
    after_word = np.where(real[:n], np.arange(n), n + m)
    pair_of = np.full(len(local.grams), -1)
    pair_of[local.two] = np.where(real[n:], n + np.arange(m), -1)
    target = np.where(pair_of[some] >= 0, pair_of[some], after_word[w])
    target[~words] = target[words][up]
    fail = np.concatenate((np.full(n, n + m), last))
    return Automaton(n, arcs, np.log10(p), target, fail, np.log10(spared / mass), root, after_word), int(after_word[local.start])


_SCORES = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))])


def _scoring(shards: int, shared, least: int, total: int, distinct: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(blobs: pa.Table, sums: pa.Table) -> pa.Table:
        answers = {r["shard"]: r for r in sums.to_pylist()}
        if blobs.num_rows and not answers:
            raise ValueError("the documents were read in another order the second time: write them first")
        return pa.concat_tables([schema.empty_table(), *(score_one(pa.ipc.open_stream(x).read_all(), answers) for x in blobs.column("rows").to_pylist())])

    def score_one(table: pa.Table, answers: dict) -> pa.Table:
        hot, often = shared.value
        local = _local(table, often)
        count, types, gram_count = np.zeros(local.n, np.int64), np.zeros(len(local.contexts), np.int64), np.zeros(len(local.grams), np.int64)
        cut = np.searchsorted(local.grams, local.n**2)
        # pairs that are no contexts have no followers to be told of
        number = np.full(cut, len(local.contexts))
        number[local.two] = local.n + np.arange(len(local.two))
        types = np.append(types, 0)
        for shard, words, home, pairs, own, thirds, *_ in local.tree(shards, hot):
            r = answers[shard]
            count[words[home]] = _unpack(r["counts"], np.int64)[home]
            types[words] += _unpack(r["types"], np.int64)
            gram_count[pairs[own]] = _unpack(r["pair_counts"], np.int64)[own]
            types[number[pairs]] += _unpack(r["pair_types"], np.int64)
            gram_count[cut + thirds] = _unpack(r["third_counts"], np.int64)
        types = types[:-1]
        a, start = automaton(local, least, total, distinct, count, types, gram_count)
        docs = len(local.lengths)
        known = np.bincount(local.doc, count[local.w] > 0, docs).astype(np.int64)
        base = np.bincount(local.doc, a.root[local.w], docs)
        cols = [table.column("doc_id").to_pylist(), local.lengths - 1, known, np.full(docs, total), base, a.scores(local.seq, local.first, local.lengths, start)]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return score


_FREQUENT = T.StructType([T.StructField("hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("size", T.LongType())])


def _frequent(batches, pairs: int, block_tokens: int, lower: bool = True):
    """Hashes of words, the start, and pairs that are frequent in some block of training tokens, with their counts there; a null hash has the bytes read and tokens learned."""
    learned, held, tokens, size = [], 0, 0, 0

    def block() -> pa.RecordBatch:
        nonlocal tokens
        ids, seq, _ = _sequences(learned, lower)
        tokens += len(seq)
        h, n = _hashes(ids), len(ids)
        one = np.bincount(seq, minlength=n)
        # both words of a frequent pair are as frequent as it
        both = (one * pairs * 2 >= len(seq))[seq]
        two = seq[:-1] * n + seq[1:]
        two, c = np.unique(two[both[:-1] & both[1:]], return_counts=True)
        some, many = (one * HOT * 2 >= len(seq)) & (np.arange(n) != 1), (c * pairs * 2 >= len(seq)) & (two // n != 1) & (two % n != 1)
        hashes = np.concatenate((h[some], _pair_hash(h[two[many] // n], h[two[many] % n])))
        counts = np.concatenate((one[some], c[many]))
        return pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(counts), pa.array(np.zeros(len(counts), np.int64))], ["hash", "n", "size"])

    for b in batches:
        for text, learns in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            x = text.as_py() or ""
            size += len(x.encode("utf-8", "surrogatepass")) + 1
            if learns:
                learned.append(x)
                held += len(x)
            if held >= 6 * block_tokens:
                yield block()
                learned, held = [], 0
    if learned:
        yield block()
    yield pa.record_batch([pa.array([None], pa.int64()), pa.array([tokens], pa.int64()), pa.array([size], pa.int64())], ["hash", "n", "size"])


def scored(docs: DataFrame, batch_bytes: int = BATCH_BYTES, pairs: int | None = None, block_tokens: int = BLOCK) -> DataFrame:
    """One row (doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of docs (doc_id, text, learned).

    Every pair of words is a state; with pairs only those that make up one in so many training tokens (words, starts and ends) or more.
    The model learns from the rows where learned is true (null: false) and scores all rows; a null text counts as empty, which is one
    token, the end; very long texts are read whole. docs is read again and has to come in the same order then, as stored tables do; if it does not, the job ends with an error. base_score is the additive unigram score, score the automaton's, both log10. Repeated rows are counted and
    scored as often, ties alike; a table without learned rows gives scores of an empty model; an empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce("learned", F.lit(False)).alias("learned"))
    # without a bound on states only hot pairs are asked for
    rare = HOT if pairs is None else max(pairs, HOT)
    frequent = written(docs.select("text", "learned").mapInArrow(lambda batches: _frequent(batches, rare, block_tokens), _FREQUENT).groupBy("hash").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "frequent")
    whole = frequent.where("hash is null").first()
    tokens, size = (whole["n"], whole["size"]) if whole else (0, 0)
    shards = max(1, -(-size // (batch_bytes * SHARE)))
    # what is frequent somewhere may be so in all; at most 2 * rare and 2 * HOT of the tokens' hashes pass
    near = frequent.where(F.col("hash").isNotNull() & (F.col("n") * 2 * rare >= tokens)).select("hash", "n").toArrow()
    often, held = near.column("hash").to_numpy().astype(np.int64).view(np.uint64), near.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((often[held * 2 * HOT >= tokens], None if pairs is None else often))
    sums = written(docs.mapInArrow(_asking_trees(shards, shared, batch_bytes), _TREE_ASK).groupBy("shard").applyInArrow(thrifty(_summing_trees), _TREE_SUMS), "sums")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    score = _scoring(shards, shared, 1 if pairs is None else -(-tokens // pairs), total["n"], total["v"])
    return docs.mapInArrow(_blobs(batch_bytes), _BLOBS).groupBy("batch").cogroup(sums.groupBy("batch")).applyInArrow(thrifty(score), _SCORES)


def op3_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = scored(docs.select("doc_id", "text", (id_crc(F.col("doc_id")) % 10 != 0).alias("learned")))
    return out.select("doc_id", (id_crc(F.col("doc_id")) % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
