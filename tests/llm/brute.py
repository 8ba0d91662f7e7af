"""Plain versions of the operators, on lists of rows."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def marks_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def quality(text):
    """Counts, verdict and cleaned text of one text."""
    text = text or ""
    words = WORD.findall(text)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeats = {p for at in where.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = text.split("\n")
    seen, n_dup = set(), 0
    for line in lines:
        if WORD.search(line):
            n_dup += line in seen
            seen.add(line)
    kept = [x for x in lines if not line_fails(x)]
    chars = sum(map(len, words))
    left = sum(len(w) for x in kept for w in WORD.findall(x))
    failed = len(words) < 50 or 100 * len(repeats) > 50 * len(words)
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": n_dup,
        "n_repeat_words": len(repeats),
        "base_failed": failed,
        "kept": not failed and not chars - left > 0.5 * chars,
        "lost_chars": chars - left,
        "clean": "\n".join(kept),
    }


def line_fails(line):
    if not WORD.search(line):
        return False
    boilerplate = (
        "all rights reserved|privacy policy|terms of (use|service)|cookie|javascript|click here|read more|"
        "sign up|log ?in|subscribe to|share this|skip to content|back to top"
    )
    return bool(
        sum(c in "|»›·•" for c in line) >= 3
        or sum(c in "#*$%&|<>" for c in line) >= 0.1 * len(line)
        or (len(line) <= 200 and re.search(boilerplate, line.lower()))
        or (len(line) < 20 and line.rstrip(" \t\n\x0b\x0c\r")[-1:] not in list(".!?…:;,\"'”’»)]。！？।؟۔"))
    )


def dedup_lines(rows, size=3, long_words=None):
    """(doc_id, text) in order -> doc_id -> lines with ink, indices that go, text left.
    ``long_words``: runs of fewer lines count if they have so many words."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        ink = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for i in range(len(ink) - size + 1):
            window = tuple(lines[k] for k in ink[i : i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        for fewer in range(1, size) if long_words else ():
            for i in range(len(ink) - fewer + 1):
                window = tuple(lines[k] for k in ink[i : i + fewer])
                if sum(len(WORD.findall(x)) for x in window) >= long_words:
                    if window in seen:
                        gone.update(range(i, i + fewer))
                    seen.add(window)
        at = {ink[i] for i in gone}
        left = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in at)
        out[doc_id] = (len(ink), gone, left)
    return out


def leaks(text, items):
    """Words, hit words and ids of the items (id, text) with an occurring window."""
    words, hit, named = marks_words(text), set(), set()
    for item_id, item in items:
        w = marks_words(item)
        size = min(10, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                named.add("" if item_id is None else str(item_id))
    return len(words), hit, sorted(named)


def shingles(text):
    words = WORD.findall(lower(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near(rows):
    """(doc_id, n_shingles, component, kept) of all rows, by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is None or j is None or not s or not t:
                continue
            if 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(
        ((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets),
        key=repr,
    )
