"""Putting markers behind the claims that a body holds: all claims are looked up in one pass, and the body is spliced once."""

from __future__ import annotations

import re
from bisect import bisect_right, insort

import ahocorasick

_GROUP = re.compile(r"\[\d+\]")
#: Texts that could be found in, or across, a marker that was put in.
_LIKE_MARKER = re.compile(r"[\[\]]|^\d+$")


class _Markers:
    """Which sequences of `[n]` groups stand in a text, as runs of groups are added at places of it."""

    def __init__(self):
        self.runs: dict[int, list[str]] = {}
        self.held: dict[int, set[tuple[str, ...]]] = {}

    def _of_length(self, n: int) -> set[tuple[str, ...]]:
        if n not in self.held:
            self.held[n] = {tuple(run[k : k + n]) for run in self.runs.values() for k in range(len(run) - n + 1)}
        return self.held[n]

    def has(self, groups: list[str]) -> bool:
        return tuple(groups) in self._of_length(len(groups))

    def put(self, place: int, groups: list[str]) -> None:
        """Groups go in front of those that stand at the place already."""
        run = self.runs[place] = groups + self.runs.get(place, [])
        for n, held in self.held.items():
            held.update(tuple(run[k : k + n]) for k in range(min(len(groups), len(run) - n + 1)))


def _first_places(body: str, wanted: list[str]) -> dict[str, int]:
    """Where each of the texts that the body holds begins first."""
    automaton = ahocorasick.Automaton()
    for text in wanted:
        automaton.add_word(text, text)
    automaton.make_automaton()
    found: dict[str, int] = {}
    for end, text in automaton.iter(body):
        if text not in found:
            found[text] = end - len(text) + 1
    return found


def annotated(body: str, claims: list[tuple[str, str]]) -> str:
    """The body with the marker of each of `claims` (stripped text, marker), in order, behind the first place where its text stands.

    A claim without text or marker is passed over, and so is one whose marker the body already holds by
    then.  A marker inside a claim's text parts it: such a place is none for the claim any more.
    """
    claims = [(text, marker) for text, marker in claims if text and marker]
    if not body or not claims:
        return body
    if _GROUP.search(body) or any(_LIKE_MARKER.search(text) for text, _ in claims):
        return _one_by_one(body, claims)
    first, points, markers = _first_places(body, list(dict.fromkeys(text for text, _ in claims))), [], _Markers()
    for text, marker in claims:
        groups = _GROUP.findall(marker)
        if text not in first or markers.has(groups):
            continue
        at = first[text]
        # The next point behind the beginning must not lie before the end.
        while at >= 0 and (k := bisect_right(points, at)) < len(points) and points[k] < at + len(text):
            at = body.find(text, at + 1)
        if at < 0:
            del first[text]
            continue
        place, first[text] = at + len(text), at
        if place not in markers.runs:
            insort(points, place)
        markers.put(place, groups)
    out, done = [], 0
    for place in points:
        out += [body[done:place], *markers.runs[place]]
        done = place
    return "".join([*out, body[done:]])


def _one_by_one(body: str, claims: list[tuple[str, str]]) -> str:
    """The same for bodies that hold markers of their own and claims that could be found in markers."""
    for text, marker in claims:
        if marker not in body and (at := body.find(text)) >= 0:
            body = f"{body[: at + len(text)]}{marker}{body[at + len(text) :]}"
    return body


def missing(body: str, texts: list[str]) -> list[bool]:
    """For each text with its white space collapsed, whether the collapsed body lacks it."""
    found = _first_places(body, list({t for t in texts if t})) if body and any(texts) else {}
    return [t not in found for t in texts]
