"""The audit of five filters against a plain run of every order."""

import itertools
import re

import pytest
from archgraph.llm import interactions


def plain(docs, labels):
    """The contract, order by order, document by document."""
    rows = [(i, s or "", t or "") for i, t, s in docs]
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    flags = []
    for i, part, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        flags.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and u == text for j, _, u in rows),
        })
    out = {}
    for part in {s for _, s, _ in rows}:
        mine = [k for k, r in enumerate(rows) if r[1] == part]
        total = dict.fromkeys("ABCDE", 0)
        found = {}
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [k for k in left if flags[k][x]]
                redundant = sum(flags[k][x] for k in mine) - len(gone)
                unique = sum(flags[k][x] and sum(flags[k].values()) == 1 for k in mine)
                left = [k for k in left if not flags[k][x]]
                total[x] += len(gone)
                found["".join(order), step] = (len(left), len(gone), redundant, unique, *(sum(rows[k][0] in of for k in gone) for of in (good, toxic)))
        out |= {(part, o, n): (*v, total[o[n - 1]]) for (o, n), v in found.items()}
    return out


TEXTS = ["x " * 250, " ".join(f"w{k}" for k in range(220)), "LOUD " * 210, "a#b " + " ".join(f"v{k}" for k in range(300)), "", None, "É Ü " * 5, "short"]


def test_audit_equals_a_plain_run(spark):
    docs = [(i, TEXTS[i * 7 % 8 if i % 3 else i % 8], [None, "", "s", "t"][i % 4]) for i in range(40)]
    docs += [(None, TEXTS[1], "s"), (None, TEXTS[1], "s"), (3, docs[3][1], "t"), (50, TEXTS[1], "s"), (51, "y " * 30_000, "t")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 1, None), (6, None, 1)]
    got = interactions.audit(
        spark.createDataFrame([(i, t, s, 0) for i, t, s in docs], "doc_id long, text string, source string, n long"), spark.createDataFrame([*labels, (4, 1, None)], "doc_id long, quality int, toxic int")
    )
    rows = {tuple(r[:3]): tuple(r[3:]) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}
    want = plain(docs, labels)
    assert rows.keys() == want.keys() and len(rows) == 600 * 3
    assert rows == want


def test_empty_table(spark):
    assert interactions.audit(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("mask", [0, 5, 31])
def test_subsets_hold_what_passes_all_of_their_filters(spark, mask):
    cells = spark.createDataFrame([("p", *[bool(k >> b & 1) for b in range(5)], k + 1, 0, 0) for k in range(32)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, n long, good long, toxic long")
    got = {r["subset"]: r["n"] for r in interactions.survivors(cells).collect()}
    assert len(got) == 32 and got[mask] == sum(k + 1 for k in range(32) if not k & mask)
