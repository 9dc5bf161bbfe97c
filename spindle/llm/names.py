"""Packed names: blocks of texts send their distinct hashes to shards and get back one bit for each.

A name travels once for each block that has it, as the difference to the one before, and only "does it occur
again" comes back. So hot names are summed up before the shuffle, and no list of all their rows is ever made.
"""

from __future__ import annotations

import numpy as np

#: Bits of a name where it only sieves: a clash keeps something for the next step, and loses nothing.
COARSE = 48


def squeeze(keys: np.ndarray, width: int) -> bytes:
    """Sorted whole numbers of ``width`` bytes at most as differences, by byte planes."""
    d = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unsqueeze(data, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n) if n else np.zeros((0, 0), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return np.cumsum(out.view(np.uint64).reshape(-1), dtype=np.uint64)


def in_order(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The order by name and check; the checks of equal names hardly ever differ, so they are looked at first."""
    order = np.argsort(keys)
    k, c = keys[order], checks[order]
    return np.lexsort((checks, keys)) if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any() else order


def pieces(keys: np.ndarray, checks: np.ndarray | None, shards: int, coarse: bool):
    """(shard, packed names, many flags, packed checks, n) of the distinct names of a block, and each suffix's place among them."""
    if coarse:
        keys = keys >> np.uint64(64 - COARSE)
    if checks is None:
        order = np.argsort(keys)
        k = keys[order]
        new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
        c = None
    else:
        order = in_order(keys, checks)
        k, c = keys[order], checks[order]
        new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])) if len(k) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(k))) > 1
    k = k[at]
    c = None if c is None else c[at]
    # shards are ranges of names, so that their answers put together are in the order of the names
    shard = (k >> np.uint64(COARSE - 32 if coarse else 32)) * np.uint64(shards) >> np.uint64(32)
    edge = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    out = []
    for s in np.flatnonzero(np.diff(edge)):
        a, b = edge[s], edge[s + 1]
        out.append((int(s), squeeze(k[a:b], COARSE // 8 if coarse else 8), np.packbits(many[a:b]).tobytes(), b"" if c is None else c[a:b].tobytes(), int(b - a)))
    return out, place


PIECES = "shard long, block long, names binary, many binary, checks binary, n long"


def repeated(key, table):
    """For each block the flags of its names in this shard: whether any other suffix, of any block, is in the bucket."""
    import pyarrow as pa

    if key[0].as_py() < 0:  # what a block keeps for itself
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "flags": table.column("names"), "n": table.column("n")})
    n = table.column("n").to_numpy()
    keys = np.concatenate([unsqueeze(x.as_buffer(), k) for x, k in zip(table.column("names"), n)])
    again = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=k) for x, k in zip(table.column("many"), n)]).astype(bool)
    checks = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("checks")])
    order = in_order(keys, checks) if len(checks) else np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    if len(checks):
        c = checks[order]
        same &= c[1:] == c[:-1]
    edge = np.flatnonzero(np.append(True, ~same))
    size = np.diff(np.append(edge, len(k)))
    alive = np.logical_or.reduceat(again[order], edge) | (size > 1)
    flags = np.empty(len(k), bool)
    flags[order] = np.repeat(alive, size)
    at = np.append(0, np.cumsum(n))
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "flags": pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(at, at[1:])], pa.binary()), "n": table.column("n")})


def told(answers) -> tuple[bytes | None, np.ndarray]:
    """What a block kept for itself (None if nothing), and the flags of its names from all shards."""
    rows = sorted(answers.as_py(), key=lambda r: r["shard"]) if answers.is_valid else []
    own = [r["flags"] for r in rows if r["shard"] < 0]
    flags = [np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=r["n"]) for r in rows if r["shard"] >= 0]
    return (own[0] if own else None), (np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool))


def batch_of(block: int, out: list[tuple]):
    """The record batch of a block's pieces."""
    import pyarrow as pa

    columns = list(zip(*out)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([block] * len(out), pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:4]), pa.array(columns[4], pa.int64())], names=["shard", "block", "names", "many", "checks", "n"])
