import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm.exact_dedup import PatriciaTrie, exact_owners

from .fixtures import frame


@given(st.lists(st.binary(max_size=12), max_size=60))
def test_trie_holds_what_was_inserted(keys):
    trie = PatriciaTrie()
    for k in keys:
        node = trie.slot(k)
        node[2] = (node[2] or 0) + 1
    assert dict(trie.terminals()) == {k: keys.count(k) for k in keys}


def brute(rows, largest):
    groups = {}
    for i, t in rows:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(key, []).append(i)
    out = []
    for key, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(key.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("owner", ["smallest", "largest"])
@pytest.mark.parametrize("memory", [64 << 20, 64])
def test_against_brute_force(spark, owner, memory):
    rows = [(i, f"Text {i % 7}") for i in range(40)] + [(100, None), (101, ""), (None, "TEXT 3"), (None, "alone"), (7, "text 0"), (7, "text 0")]
    rows += [(200, "É"), (201, "é"), (300, "x" * 200_000), (301, "X" * 200_000)]
    got = exact_owners(frame(spark, rows).repartition(5), owner=owner, memory_bytes=memory).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows, owner == "largest")
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})  # exactly one a group, repeated rows included
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty(spark):
    assert exact_owners(frame(spark, [])).count() == 0
