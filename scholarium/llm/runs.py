"""Streaming over sorted rows: keep only the groups with at least two members."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def repeated_groups(key: str | tuple[str, ...], member: tuple[str, ...], aside=None):
    """A function for mapInArrow over rows sorted by ``key``, then ``member``.

    Repeats of a member in a group fall away, then groups with one member.
    Only the last row of a batch waits for the next, so memory stays small
    however large a group is.  ``aside`` parts a batch into rows to be grouped
    and rows that go out as they are.
    """

    keys = (key,) if isinstance(key, str) else key

    def run(batches):
        last, sent = None, False  # the row that may still begin a group; whether it went out already
        for batch in batches:
            if aside is not None:
                batch, through = aside(batch)
                if through.num_rows:
                    yield through
            if not batch.num_rows:
                continue
            t = pa.table(batch) if last is None else pa.concat_tables([last, pa.table(batch)]).combine_chunks()
            same = np.ones(t.num_rows - 1, bool)
            for k in keys:
                v = t.column(k).to_numpy()
                same &= v[1:] == v[:-1]
            repeat = same.copy()
            for m in member:
                v = t.column(m).to_numpy()
                repeat &= v[1:] == v[:-1]
            at = np.flatnonzero(np.concatenate([[True], ~repeat]))
            pair = same[at[1:] - 1]  # repeats in between have the same key as the row before them
            keep = np.zeros(len(at), bool)
            keep[1:] |= pair
            keep[:-1] |= pair
            ends_in_group = bool(keep[-1])
            if sent:
                keep[0] = False
            if keep.any():
                yield from t.take(pa.array(at[keep])).to_batches()
            sent = sent if len(at) == 1 else ends_in_group
            last = t.slice(int(at[-1]), 1)

    return run


def pairs_and_groups(fits):
    """A function for mapInArrow over rows (key, node, size) sorted by key, then node.

    A group of two becomes a row (node, size, other) where ``fits(sizes, sizes)``
    holds; the members of larger groups stay rows with their key; others fall
    away.  At most two rows of a group wait for the next batch.
    """
    names = ["key", "node", "size", "other"]

    def run(batches):
        key, node, size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        open_big, last_node = None, None  # the key of a large group that may go on, and its last member

        def rows(final: bool):
            nonlocal key, node, size, open_big, last_node
            if not len(key):
                return None
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            if open_big is not None and key[0] == open_big and node[0] == last_node:
                fresh[0] = False
                # a long repeat of the last member
                same = (key == open_big) & (node == last_node)
                fresh &= ~same
            k, v, s = key[fresh], node[fresh], size[fresh]
            if not len(k):
                key, node, size = k, v, s
                return None
            begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            count = np.diff(np.append(begin, len(k)))
            big = count >= 3
            if open_big is not None and k[0] == open_big:
                big[0] = True
            wait = 0
            if not final and not big[-1]:
                wait = int(count[-1])
            n_groups = len(begin) - bool(wait)
            if not final:
                open_big, last_node = (int(k[-1]), int(v[-1])) if big[-1] else (None, None)
            two = begin[:n_groups][(count[:n_groups] == 2) & ~big[:n_groups]]
            two = two[fits(s[two], s[two + 1])]
            members = np.repeat(big[:n_groups], count[:n_groups])
            m = np.flatnonzero(members)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([k[m], k[two]])),
                    pa.array(np.concatenate([v[m], v[two]])),
                    pa.array(np.concatenate([s[m], s[two]])),
                    pa.array(np.concatenate([v[m], v[two + 1]]), mask=np.concatenate([np.ones(len(m), bool), np.zeros(len(two), bool)])),
                ],
                names,
            )
            at = len(k) - wait
            key, node, size = k[at:], v[at:], s[at:]
            return out

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            node = np.concatenate([node, batch.column("node").to_numpy()])
            size = np.concatenate([size, batch.column("size").to_numpy()])
            if (out := rows(False)) is not None:
                yield out
        if (out := rows(True)) is not None:
            yield out

    return run
