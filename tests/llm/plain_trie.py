"""A plain version of the trie of conversation prefixes."""

import hashlib
import zlib
from collections import defaultdict


def plain_trie(rows):
    """Node tuples of (conv_id, turn, role, text) rows, as the operator returns them."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}|{role}{text}".encode()).hexdigest()[:30]
            turns[conv].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [t[-1] for t in sorted(v, key=lambda t: t[:3])] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += node not in children
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]),
                   leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
                  for n in list(members))
