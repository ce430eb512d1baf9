import hashlib
import re
from collections import defaultdict

from marlstone.llm import exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_groups(docs, edge):
    out = exact_dedup.exact_groups(docs).collect()
    assert len(out) == len(edge)
    ids = defaultdict(list)
    for d, t in edge:
        ids[hashlib.sha256(norm(t).encode()).hexdigest()].append(d)
    kept = defaultdict(int)
    for r in out:
        own = ids[r["text_sha256"]]
        least = min((d for d in own if d is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (least, len(own))
        assert not r["kept"] or r["doc_id"] == least
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept) == set(ids) and set(kept.values()) == {1}


def test_kept_rows_have_their_columns(docs, edge):
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(norm(r["text"]) for r in rows) == sorted({norm(t) for _, t in edge})
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows)


def test_empty(none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
