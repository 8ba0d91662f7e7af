"""Small inputs, and plain restatements of the rules to compare with."""

import random
import re
from bisect import bisect_left
from itertools import accumulate

CUE_COLUMNS = "file_id string, cue bigint, start_ms bigint, end_ms bigint, content string, proprietary string"

HARBOUR = [
    (500, 1900, "Fog hides the pier."),
    (2100, 4600, "A gull lands, looks at us,"),
    (4700, 5200, "and steals\nthe bread! Nobody"),
    (9000, 12500, "laughs."),
]
OVEN = [(0, 800, "Who is\nthere?"), (800, 4000, "Only the oven. It hums")]
LOOSE = (
    "3\n0:00:10,200 --> 0:00:11,000\nTwo boats\n"
    "4\n0:01:00,000 --> 0:01:09,999\nleft at dawn,\none with\nno oars\n"
)


def cue_table(spark, files):
    """``files``: name -> list of contents, or of (start, end, content)."""
    rows = []
    for name, cues in files.items():
        for at, cue in enumerate(cues):
            if isinstance(cue, str):
                cue = (at * 3000, at * 3000 + 2500, cue)
            rows.append((name, at + 1, cue[0], cue[1], cue[2], ""))
    return spark.createDataFrame(rows, CUE_COLUMNS)


# Fixed value: the boundary rule itself.
def pattern(profile="v1"):
    if profile == "v0":
        return re.compile(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s")
    return re.compile(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<!\b[A-Za-z]\.)(?<=\.|\?|\!)\s")


def plain_sentences(contents, profile="v1"):
    text = "".join(c.replace("\n", " ") + " " for c in contents)
    if profile == "v0":
        return pattern("v0").split(text[:-1])
    text = text.rstrip()
    return [s for s in pattern().split(text) if s.strip()] if text else []


def plain_alignment(contents):
    """cue -> (sentence, rel) or None, from offsets by bisection."""
    ends = list(accumulate(len(c) + 1 for c in contents))
    stops = list(accumulate(len(s) + 1 for s in plain_sentences(contents)))
    found = {}
    for cue, end in enumerate(ends, 1):
        at = bisect_left(stops, end)
        begin = stops[at - 1] if 0 < at <= len(stops) else 0
        found[cue] = (at + 1, end - begin) if at < len(stops) else None
    return found


def plain_nearest_space(text, cut):
    spaces = [i for i, c in enumerate(text) if c == " "]
    if not text:
        return 0
    if not spaces:
        return cut
    left = max((i for i in spaces if i < cut), default=None)
    right = min((i for i in spaces if i >= cut), default=None)
    if left is None or (right is not None and cut - left > right - cut):
        return right + 1
    return left + 1


def plain_pieces(text, rels, space):
    """The pieces of one translated sentence in compat mode."""
    if len(rels) == 1:
        return [text[: rels[0]]]
    cuts = [len(text) * r // rels[-1] for r in rels[:-1]]
    if space:
        cuts = [plain_nearest_space(text, c) for c in cuts]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


def random_contents(seed, n=40):
    rng = random.Random(seed)
    words = ["Mr.", "a.m.", "Hi!", "Why?", "end.", "x.", "é.", "word", "two", "A.", "U.S.A.", "?", "\n", " ", "日本。", "_b."]
    return [
        " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
        + rng.choice(["", "", "", ".", "\n", "! "])
        for _ in range(n)
    ]
