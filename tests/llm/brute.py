"""Repeated passages by plain loops over words, apart from the operator's own cutting (texts without CJK stops)."""

import re

STOPS = tuple(".!?…,;:")


def segments(text, lines):
    """[first word, end) of each sentence; ``lines``: single line ends cut as well."""
    words = [(m.group(), m.end()) for m in re.finditer(r"\S+", text)]
    ends = []
    for k, (word, end) in enumerate(words):
        after = text[end : words[k + 1][1] - len(words[k + 1][0])] if k + 1 < len(words) else "\n\n"
        if word.endswith(STOPS) or after.count("\n") >= 2 or (lines and "\n" in after):
            ends.append(k + 1)
    return list(zip([0, *ends], ends))


def runs(text, words):
    """(first word, end) of the shortest runs of two sentences or more that start or end at each."""
    out = set()
    for lines in (True, False):
        own = segments(text, lines)
        for i in range(len(own)):
            long = [j for j in range(i + 1, len(own)) if own[j][1] - own[i][0] >= words]
            if long:
                out.add((own[i][0], own[long[0]][1]))
            long = [j for j in range(i) if own[i][1] - own[j][0] >= words]
            if long:
                out.add((own[long[-1]][0], own[i][1]))
    return sorted(out)


def without_repeats(docs, words=20):
    """docs: {doc_id: text} with distinct ids.  The words that stay of each."""
    first = {}
    for i in sorted(docs):
        low = docs[i].lower().split()
        for a, b in runs(docs[i], words):
            first.setdefault(tuple(low[a:b]), (i, b))
    out = {}
    for i, text in docs.items():
        own, low, lost = text.split(), text.lower().split(), set()
        for a, b in runs(text, words):
            doc, end = first[tuple(low[a:b])]
            if doc != i or a >= end:
                lost |= set(range(a, b))
        out[i] = [w for k, w in enumerate(own) if k not in lost]
    return out
