"""Deep-shallow sorting of text windows, vectorised: all groups of a step are split at once.

Windows of ``WIDTH`` bytes that may be equal come as groups. Multikey quicksort splits a group on
one word of eight bytes at a time (below, equal to, above a pivot) down to a shallow depth. What
is still equal there has a long common prefix and is ordered by a blind trie: a node holds the
depth at which its members first differ and branches by that byte alone, so nothing between two
nodes is looked at again."""

from __future__ import annotations

import numpy as np

#: Bytes of a window, and those that multikey quicksort looks at: words of eight.
WIDTH = 100
SHALLOW = 24


def _inside(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers 0, 1, .. of the runs of equal values in ``group``, and where each run starts."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _kept(run: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the run of each member has another one."""
    return np.diff(np.append(starts, len(run)))[run] > 1


def _multikey(words: np.ndarray, at: np.ndarray, group: np.ndarray, perm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders ``perm`` inside each group down to ``SHALLOW`` bytes. Returns the slots whose windows
    agree with a neighbour so far, and the group of each."""
    slots, run, depth = np.arange(len(perm)), group.astype(np.int64), np.zeros(len(perm), np.int64)
    deep_slots, deep_runs, made = [], [], int(group.max(initial=0)) + 1
    while True:
        run, starts = _inside(run)
        live = _kept(run, starts)
        slots, run, depth = slots[live], run[live], depth[live]
        done = depth >= SHALLOW
        if done.any():
            deep_slots.append(slots[done])
            deep_runs.append(run[done] + made)
            made += int(run.max()) + 1
            slots, run, depth = slots[~done], run[~done], depth[~done]
        if not len(slots):
            break
        run, starts = _inside(run)
        key = words[at[perm[slots]] + depth]
        middle = starts + np.diff(np.append(starts, len(run))) // 2
        pivot = key[middle][run]
        side = run * 3 + 1 + (key > pivot) - (key < pivot)
        order = np.argsort(side, kind="stable")
        perm[slots] = perm[slots][order]
        run, depth = side[order], depth[order] + 8 * (side[order] % 3 == 1)
    slots = np.concatenate(deep_slots) if deep_slots else np.empty(0, np.int64)
    runs = np.concatenate(deep_runs) if deep_runs else np.empty(0, np.int64)
    order = np.argsort(slots)
    return slots[order], runs[order]


def sorted_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows of ``data`` that start at ``at``, inside each value of ``group`` (which is
    sorted), and for each slot of that order whether its window equals that of the slot before.

    Windows of different groups are never equal for the caller and are not compared."""
    perm, equal = np.arange(len(at)), np.zeros(len(at), bool)
    if not len(at):
        return perm, equal
    views = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
    words = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(">u8")[:, 0].astype(np.uint64)
    slots, run = _multikey(words, at, group, perm)
    # blind tries, one below each group, breadth first: ``run`` is the node of a slot
    while len(slots):
        run, starts = _inside(run)
        live = _kept(run, starts)
        slots = slots[live]
        if not len(slots):
            break
        run, starts = _inside(run[live])
        mine = at[perm[slots]]
        differs = views[mine] != views[mine[starts]][run]
        depth = np.where(differs.any(1), differs.argmax(1), WIDTH)
        node = np.minimum.reduceat(depth, starts)[run]
        leaf = node == WIDTH
        follows = leaf.copy()
        follows[starts] = False
        equal[slots[follows]] = True
        slots, run, mine, node = slots[~leaf], run[~leaf], mine[~leaf], node[~leaf]
        branch = run * 256 + data[mine + node]
        order = np.argsort(branch, kind="stable")
        perm[slots] = perm[slots][order]
        run = branch[order]
    return perm, equal
