"""Token counts by trie-shared dynamic programming.

Pre-tokens are the words `[^\\x20\\x09-\\x0D]+` with a space before each. Under a unigram model over the pieces of a
vocabulary file, a pre-token's count is the number of pieces of its cheapest segmentation (of equal ones, the shortest). A
trie holds the distinct pre-tokens that a worker has met; each node keeps the cheapest cost and count of its prefix, so a
prefix shared by many pre-tokens is computed once; terminal nodes' counts are stored per pre-token and summed per document.

The model isn't trained: the piece of rank r costs log((r + 1) * H), in whole micro-units, where H normalises 1 / (r + 1) over
the vocabulary. Every byte is a piece, so every text has a segmentation. Nothing is shuffled; a worker's trie starts anew
beyond MAX_NODES nodes, within a text too, and a pre-token above LONG_WORD bytes is computed beside the trie with the scores of
its last bytes only; neither changes a result. Null and empty texts count 0; null ids and repeated rows are kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

MAX_NODES = 1_000_000
#: Bytes from which a pre-token isn't kept in the trie.
LONG_WORD = 4096
#: Low bits of a cost that hold the number of pieces.
COUNT_BITS = 32


def unigram_costs(path: str) -> dict[bytes, int]:
    """Whole-number costs of the pieces of a rank file, shifted so that 1 in the low bits counts the piece."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {p: (round(1e6 * (math.log(r + 1) + norm)) << COUNT_BITS) + 1 for p, r in ranks.items()}


class Trie:
    """Prefixes with the cheapest cost and its count for each."""

    def __init__(self, costs: dict[bytes, int], max_nodes: int = MAX_NODES) -> None:
        self.costs, self.max_nodes = costs, max_nodes
        self.longest = max(map(len, costs))
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.best: list[int] = [0]
        self.terminal: dict[bytes, int] = {}

    def insert(self, word: bytes) -> None:
        """Store the count of a pre-token; computes only the prefixes that the trie lacks."""
        token = b" " + word
        child, best, cost_of, longest = self.child, self.best, self.costs.get, self.longest
        node, path = 0, [0]
        for i, byte in enumerate(token, 1):
            key = node << 8 | byte
            node = child.get(key)
            if node is None:
                node = child[key] = len(best)
                least = cost_of(token[i - 1 : i]) + path[i - 1]
                for j in range(i - 2, max(0, i - longest) - 1, -1):
                    cost = cost_of(token[j:i])
                    if cost is not None and cost + path[j] < least:
                        least = cost + path[j]
                best.append(least)
                path.append(least)
            else:
                path.append(best[node])
        self.terminal[word] = path[-1] & (1 << COUNT_BITS) - 1

    def alone(self, word: bytes) -> int:
        """The count of a pre-token without the trie; holds as many scores as the longest piece has bytes."""
        token = b" " + word
        cost_of, longest = self.costs.get, self.longest
        last = [0]  # of the prefixes that end in the last bytes
        for i in range(1, len(token) + 1):
            least = cost_of(token[i - 1 : i]) + last[-1]
            for k in range(2, len(last) + 1):
                cost = cost_of(token[i - k : i])
                if cost is not None and cost + last[-k] < least:
                    least = cost + last[-k]
            last.append(least)
            if len(last) > longest:
                del last[0]
        return last[-1] & (1 << COUNT_BITS) - 1

    def count(self, text: str | None) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        total, terminal = 0, self.terminal
        for w, n in Counter(words).items():
            c = terminal.get(w)
            if c is None:
                if len(w) > LONG_WORD:
                    c = self.alone(w)
                else:
                    if len(self.best) > self.max_nodes:
                        self.reset()
                        terminal = self.terminal
                    self.insert(w)
                    c = terminal[w]
            total += n * c
        return len(words), total


_TRIES: dict[str, Trie] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text."""
    in_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TRIES:
            _TRIES[path] = Trie(unigram_costs(path))
        for b in batches:
            rows = [_TRIES[path].count(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
