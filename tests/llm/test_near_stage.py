import re
import sys
from pathlib import Path

from llm_fixtures import documents, edge_documents
from test_jaccard import LOW, changed, family

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402


def fives(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def stays(rows):
    """One row of each group linked by 80 % of runs of five words: the smallest id, nulls last; rows without words."""
    sets, group = [fives(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, left = set(), []
    for k in order:
        if not sets[k] or group[k] not in seen:
            seen.add(group[k])
            left.append(rows[k][0])
    return sorted(left, key=str)


def test_stage_equals_brute_force_of_five_words(spark):
    long = " ".join(f"w{k * k % 997}x{k}" for k in range(500))
    rows = edge_documents() + family()
    # 15 % more words, and 2 % of the words replaced: linked by 5 words and 80 %, not by 3 words and 90 %; 30 % more words: not linked
    rows += [(2000, long, None, None, 1), (2001, long + " " + " ".join(f"more{k}" for k in range(75)), None, None, 1), (2002, changed(long, range(10, 500, 50)), None, None, 1), (2003, long + " " + " ".join(f"other{k}" for k in range(150)), None, None, 1)]
    got = sorted((r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()), key=str)
    assert got == stays(rows)
    assert 2000 in got and 2003 in got and 2001 not in got and 2002 not in got
