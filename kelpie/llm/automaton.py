"""A suffix automaton over words that knows, for every substring, the smallest document it occurs in."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """Built from reference spans, each with its document; ``window`` is the length whose matches are asked for."""

    def __init__(self, spans: Iterable[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        none = (1 << 63) - 1
        self.first = [none]
        codes, separator = self.codes, -1
        following, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for doc, words in spans:
            for code in (*(codes.setdefault(w, len(codes)) for w in words), separator):
                state = len(length)
                length.append(length[last] + 1)
                following.append({})
                link.append(0)
                # A separator ends a span; it comes once, so nothing runs across it.
                first.append(doc if code >= 0 else none)
                at = last
                while at >= 0 and code not in following[at]:
                    following[at][code] = state
                    at = link[at]
                if at >= 0:
                    target = following[at][code]
                    if length[at] + 1 == length[target]:
                        link[state] = target
                    else:
                        copy = len(length)
                        length.append(length[at] + 1)
                        following.append(following[target].copy())
                        link.append(link[target])
                        first.append(none)
                        while at >= 0 and following[at].get(code) == target:
                            following[at][code] = copy
                            at = link[at]
                        link[target] = link[state] = copy
                last = state
            # The next span starts afresh; its words cannot follow on this separator.
            separator -= 1
        # Longest first: a state's occurrences are also its suffix link's.
        for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            if first[state] < first[link[state]]:
                first[link[state]] = first[state]

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each window of a text the smallest document that holds it, or the largest long."""
        following, link, length, first, window = self.next, self.link, self.length, self.first, self.window
        none = (1 << 63) - 1
        out, state, size, get = [], 0, 0, self.codes.get
        for i, word in enumerate(words):
            code = get(word, None)
            if code is None:
                state = size = 0
            else:
                while state and code not in following[state]:
                    state = link[state]
                    size = length[state]
                if code in following[state]:
                    state = following[state][code]
                    size += 1
                    # Matches longer than a window are cut to it: the state is that of the window itself.
                    while link[state] >= 0 and length[link[state]] >= window:
                        state = link[state]
                    if size > window and size > length[state]:
                        size = length[state]
                else:
                    size = 0
            if i >= window - 1:
                out.append(first[state] if size >= window else none)
        return out
