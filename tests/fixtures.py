"""Small graphs: the six-node sample of the survey, and awkward ones."""

# R0 raw sample, R raw, S silver, D drug dimension, M manufacturer dimension, F fact.
SAMPLE = [
    ("D", "F", True),
    ("S", "F", True),
    ("R", "F", True),
    ("R0", "R", False),
    ("R", "S", False),
    ("R", "D", True),
    ("S", "D", True),
    ("M", "D", True),
    ("R", "M", True),
    ("S", "M", True),
]
CYCLE = [("a", "b"), ("b", "c"), ("c", "a")]
SELF_LOOP = [("a", "a"), ("a", "b")]
TWO_PARTS = [("a", "b"), ("x", "y")]


def pairs(edges):
    return [e[:2] for e in edges]


def brute_distances(edges, root, direction):
    """Distances from a root, by plain breadth-first search."""
    step = {}
    for a, b, *_ in edges:
        if direction in ("downstream", "both"):
            step.setdefault(a, set()).add(b)
        if direction in ("upstream", "both"):
            step.setdefault(b, set()).add(a)
    found, ring, dist = {root: 0}, {root}, 0
    while ring:
        dist += 1
        ring = {n for here in ring for n in step.get(here, ()) if n not in found}
        found.update(dict.fromkeys(ring, dist))
    return found
