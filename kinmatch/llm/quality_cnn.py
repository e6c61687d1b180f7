"""Document quality by a byte-level convolutional network, in numpy.

The bytes of a text pass an embedding and a layer of learned filters (width WIDTH, stride STRIDE). The filters' outputs
are max-pooled in each of the overlapping chunks that cover the whole document; the mean and the maximum over chunks
make the document's features, which one dense layer turns into a probability.

Embedding and filters act on one byte at a time, so at scoring time their product is a table per filter tap, and the
convolution is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import fields, is_held_out, portions, without

#: Labelled rows used for fitting, at most so many of each class.
SAMPLE = {0: 1200, 1: 1200}
WIDTH, STRIDE, EMBED, FILTERS = 6, 2, 8, 24
#: A block is BLOCK filter positions; a chunk is CHUNK blocks and starts every HOP blocks, so chunks overlap by half.
BLOCK, CHUNK, HOP = 32, 4, 2


@dataclass(frozen=True)
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    dense: np.ndarray  # 2 * FILTERS
    offset: float

    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.embed, self.filters).astype(np.float32)


def positions(n_bytes: int) -> int:
    """Filter positions of a text; a short one is padded with zero bytes to a single position at least."""
    return max(1, -(-(max(n_bytes, WIDTH) - WIDTH) // STRIDE) + 1)


def padded(text: bytes) -> np.ndarray:
    n = positions(len(text))
    out = np.zeros((n - 1) * STRIDE + WIDTH, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def block_max(data: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Maximum of each filter in each block of BLOCK positions, for one padded text; done in slices of bounded size."""
    n = (len(data) - WIDTH) // STRIDE + 1
    out = np.empty((-(-n // BLOCK), FILTERS), np.float32)
    step = BLOCK * 128
    for at in range(0, n, step):
        to = min(n, at + step)
        part = data[at * STRIDE : (to - 1) * STRIDE + WIDTH]
        sums = tables[0][part[0 : (to - at - 1) * STRIDE + 1 : STRIDE]]
        for w in range(1, WIDTH):
            sums += tables[w][part[w : w + (to - at - 1) * STRIDE + 1 : STRIDE]]
        out[at // BLOCK : -(-to // BLOCK)] = np.maximum.reduceat(sums, np.arange(0, to - at, BLOCK))
    return out


def chunk_starts(n_blocks: int) -> np.ndarray:
    """First blocks of the chunks that cover all n_blocks."""
    return np.arange(0, max(1, n_blocks - CHUNK + HOP), HOP)


def pooled(blocks: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Each chunk's rectified maxima; the last chunk may be shorter."""
    starts = chunk_starts(len(blocks))
    out = blocks[starts]
    for k in range(1, CHUNK):
        out = np.maximum(out, blocks[np.minimum(starts + k, len(blocks) - 1)])
    return np.maximum(out + bias, 0)


class Scorer:
    def __init__(self, net: Network):
        self.net, self._tables = net, net.tables()

    def score(self, text: str) -> float:
        chunks = pooled(block_max(padded(text.encode("utf-8", "replace")), self._tables), self.net.bias.astype(np.float32))
        z = float(np.concatenate([chunks.mean(0), chunks.max(0)]) @ self.net.dense + self.net.offset)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(rows: list[tuple[int, str, int]], epochs: int = 6, seed: int = 7, rate: float = 0.01) -> Network:
    """Trains by Adam on the labelled rows (held-out ids are left out); the classes weigh alike.

    A training step sees the whole of a text or, one in three times, a short run of it, so that short texts are learned
    too.
    Only maxima pass gradients on, so a step touches few filter positions.
    """
    rng = np.random.default_rng(seed)
    rows = [r for r in rows if not is_held_out(r[0])]
    net = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "filters": rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)),
        "bias": np.zeros(FILTERS),
        "dense": rng.normal(0, 0.1, 2 * FILTERS),
        "offset": np.zeros(1),
    }
    y = np.array([r[2] for r in rows], float)
    if len(set(y)) < 2:
        net["dense"][:] = 0
        net["offset"][:] = 2.0 if not len(y) or y[0] else -2.0
        return Network(net["embed"], net["filters"], net["bias"], net["dense"], float(net["offset"][0]))
    weight = np.where(y == 1, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (len(y) - y.sum()))
    data = [padded(r[1].encode("utf-8", "replace")) for r in rows]
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    steps, size = 0, 32
    total = epochs * -(-len(rows) // size)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), size):
            tables = np.einsum("be,wef->wbf", net["embed"], net["filters"]).astype(np.float32)
            d_tables = np.zeros(tables.shape)
            grad = {k: np.zeros_like(v) for k, v in net.items()}
            batch = order[at : at + size]
            for i in batch:
                doc = data[i]
                n = (len(doc) - WIDTH) // STRIDE + 1
                most = int(rng.integers(8, 128)) if rng.random() < 0.33 else n
                if n > most:
                    start = int(rng.integers(0, n - most + 1))
                    doc = doc[start * STRIDE : (start + most - 1) * STRIDE + WIDTH]
                    n = most
                sums = sum(tables[w][doc[w : w + (n - 1) * STRIDE + 1 : STRIDE]] for w in range(WIDTH))
                n_blocks = -(-n // BLOCK)
                starts = chunk_starts(n_blocks)
                where = np.stack([s * BLOCK + sums[s * BLOCK : (s + CHUNK) * BLOCK].argmax(0) for s in starts])
                best = np.take_along_axis(sums, where, 0) + net["bias"]
                live = best > 0
                best = np.where(live, best, 0)
                top = best.argmax(0)
                feats = np.concatenate([best.mean(0), best.max(0)])
                z = feats @ net["dense"] + net["offset"][0]
                slope = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[i]) * weight[i] / len(batch)
                grad["dense"] += slope * feats
                grad["offset"] += slope
                d_best = np.tile(slope * net["dense"][:FILTERS] / len(starts), (len(starts), 1))
                d_best[top, np.arange(FILTERS)] += slope * net["dense"][FILTERS:]
                d_best *= live
                grad["bias"] += d_best.sum(0)
                f = np.broadcast_to(np.arange(FILTERS), where.shape)
                for w in range(WIDTH):
                    np.add.at(d_tables[w], (doc[where * STRIDE + w], f), d_best)
            grad["embed"] = np.einsum("wbf,wef->be", d_tables, net["filters"])
            grad["filters"] = np.einsum("wbf,be->wef", d_tables, net["embed"])
            grad["dense"] += 1e-4 * net["dense"]
            steps += 1
            now = rate * (1 - 0.9 * steps / total)
            for k in net:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
                net[k] -= now * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-8)
    return Network(net["embed"], net["filters"], net["bias"], net["dense"], float(net["offset"][0]))


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: bool = False, prefix: str = "") -> DataFrame:
    """id_col, score (0 to 1) and predicted (score >= threshold) of every whole text; with keep, all columns of docs first.

    Only the text is an input of the score. A null text counts as empty, which is one position of zero bytes; repeated
    rows each give a row; null ids pass through; an empty table gives no rows. prefix is put before the names score and
    predicted; with keep, columns of docs with such a name, in upper or lower case, give way to them; without, other
    columns are not read.
    """
    added = [f"{prefix}score", f"{prefix}predicted"]
    kept = without(docs, added) if keep else docs.select(F.col(id_col), F.col(text_col).cast("string"))
    columns, at = kept.columns, kept.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(net)
        for batch in portions(batches, at):
            scores = [own.score(text or "") for text in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.columns if keep else [batch.column(0)]), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=[*(columns if keep else [id_col]), *added],
            )

    return kept.mapInArrow(score, f"{fields(kept if keep else kept.select(id_col))}, `{added[0]}` double, `{added[1]}` int")
