"""Tree diffs against a plain descent."""

import random

import pytest

from wirefold.operators.trees import fingerprint_tree, tree_diff


def under(files, folder):
    return {p: v for p, v in files.items() if folder == "" or p.startswith(folder + "/")}


def plain(old, new, folder=""):
    """Smallest changed subtrees below a folder that both sides have."""
    out, depth = [], len(folder.split("/")) if folder else 0
    names = {"/".join(p.split("/")[:depth + 1]) for p in [*under(old, folder), *under(new, folder)]}
    for name in names:
        for is_file in (True, False):
            o, n = ({p: v for p, v in side.items() if (p == name if is_file else p.startswith(name + "/"))} for side in (old, new))
            if o == n:
                continue
            if o and n and not is_file:
                out += plain(old, new, name)
            else:
                out.append((name, is_file, "added" if not o else "deleted" if not n else "modified", len(n or o)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_smallest_changed_subtrees(spark, seed):
    r = random.Random(seed)
    paths = ["/".join(r.choice("abc") for _ in range(r.randrange(1, 5))) + r.choice(["/f", "/g", ".x"]) for _ in range(40)]
    old = {p: r.randrange(3) for p in paths if r.random() < 0.8}
    new = {p: v if r.random() < 0.9 else 9 for p, v in old.items() if not p.startswith("b/") or seed} | {"z/new/one": 1, "z/new/two": 1, "top": 1}
    trees = [fingerprint_tree(spark.createDataFrame(list(s.items()), "path string, v long"), path="path", fields=["v"]) for s in (old, new)]
    got = sorted(tuple(x) for x in tree_diff(*trees).select("path", "is_file", "change", "n_files").collect())
    want = plain(old, new) if old and new else None
    assert got == sorted(want)
    assert tree_diff(trees[0], trees[0]).count() == 0


def test_empty_side_is_one_subtree(spark):
    none = spark.createDataFrame([], "path string, v long")
    some = spark.createDataFrame([("a/b", 1), (None, 2)], "path string, v long")
    a, b = (fingerprint_tree(x, path="path", fields=["v"]) for x in (none, some))
    assert [tuple(x) for x in tree_diff(a, b).select("path", "is_file", "change", "n_files").collect()] == [("", False, "added", 1)]
