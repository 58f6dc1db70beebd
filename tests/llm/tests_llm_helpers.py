"""Plain definitions that the pipeline's stages are tested against."""

import re


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


def similar(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) >= 0.8 * len(x | y)


def contaminated(t, item):
    w = re.findall(r"[a-z0-9]+", (t or "").lower())
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    return any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))
