"""Selectors of style sheets and the order in which their declarations count, as far as visibility needs them.

Selectors may name tags, classes, ids, attributes, ``:is``, ``:where`` and ``:not``, joined by descendant and child combinators. One
that holds anything else (sibling combinators, states, pseudo-elements) applies to nothing here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol


class Element(Protocol):
    tag: str
    attrs: dict[str, str]
    parent: Element | None


@dataclass
class Compound:
    """What one element must be."""

    tag: str | None = None
    names: list[tuple[str, str]] = field(default_factory=list)  # ("id" or "class", name)
    attrs: list[tuple[str, str | None]] = field(default_factory=list)
    groups: list[tuple[str, list[Selector]]] = field(default_factory=list)

    def fits(self, node: Element) -> bool:
        if self.tag and self.tag != node.tag and not (self.tag == "body" and node.parent is None):  # html and body are one here
            return False
        classes = None
        for kind, name in self.names:
            if kind == "id":
                if node.attrs.get("id") != name:
                    return False
            else:
                classes = node.attrs.get("class", "").split() if classes is None else classes
                if name not in classes:
                    return False
        if any(k not in node.attrs or (v is not None and node.attrs[k] != v) for k, v in self.attrs):
            return False
        return all(any(s.fits(node) for s in some) != (kind == "not") for kind, some in self.groups)

    def weight(self) -> tuple[int, int, int]:
        ids = sum(kind == "id" for kind, _ in self.names)
        own = [(ids, len(self.names) - ids + len(self.attrs), int(bool(self.tag)))]
        own += [max(s.weight() for s in some) for kind, some in self.groups if kind != "where"]
        return tuple(map(sum, zip(*own, strict=True)))


@dataclass
class Selector:
    """Compounds from the element outwards; each but the first with whether it must be the parent."""

    parts: list[tuple[bool, Compound]]

    def fits(self, node: Element, at: int = 0) -> bool:
        if not self.parts[at][1].fits(node):
            return False
        if at + 1 == len(self.parts):
            return True
        outer = node.parent
        while outer is not None:
            if self.fits(outer, at + 1):
                return True
            outer = None if self.parts[at + 1][0] else outer.parent
        return False

    def weight(self) -> tuple[int, int, int]:
        return tuple(map(sum, zip(*(c.weight() for _, c in self.parts), strict=True)))

    def key(self) -> str:
        """Something that every element it fits has: an id, a class, a tag, or nothing."""
        inner = self.parts[0][1]
        if inner.names:
            kind, name = inner.names[0]
            return ("#" if kind == "id" else ".") + name
        return inner.tag or "*"


_PART = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|(?P<mark>[.#])(?P<name>-?[a-zA-Z_][\w-]*)|\[\s*(?P<attr>[\w-]+)\s*(?:=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[\w-]+))\s*)?\]|:(?P<group>is|where|not)\(")
_JOIN = re.compile(r"\s*(>)\s*|\s+")


def separated(text: str) -> Iterator[str]:
    """The parts between commas outside of parentheses and brackets."""
    depth, start = 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            yield text[start:i]
            start = i + 1
    yield text[start:]


def parsed(text: str) -> Selector | None:
    """A selector, or None if it holds what isn't known here."""
    text = text.strip()
    at, parts, child = 0, [], False
    while at < len(text):
        compound, begun = Compound(), at
        while found := _PART.match(text, at):
            if found["tag"] and at > begun:
                return None
            at = found.end()
            if found["tag"]:
                compound.tag = None if found["tag"] == "*" else found["tag"].lower()
            elif found["mark"]:
                compound.names.append(("id" if found["mark"] == "#" else "class", found["name"]))
            elif found["attr"]:
                compound.attrs.append((found["attr"].lower(), next((found[k] for k in "abc" if found[k] is not None), None)))
            else:
                depth, end = 1, at
                while end < len(text) and depth:
                    depth += (text[end] == "(") - (text[end] == ")")
                    end += 1
                some = [parsed(x) for x in separated(text[at : end - 1])]
                if depth or None in some:
                    return None
                compound.groups.append((found["group"], some))
                at = end
        if at == begun:
            return None
        parts.append((child, compound))
        if at < len(text):
            join = _JOIN.match(text, at)
            if not join or join.end() == len(text):
                return None
            child, at = bool(join[1]), join.end()
    if not parts:
        return None
    # read from the left, a compound knows how it hangs below the one before it; matching goes the other way
    inner = [c for _, c in reversed(parts)]
    hangs = [h for h, _ in reversed(parts)]
    return Selector(list(zip([False, *hangs[:-1]], inner, strict=True)))


def declared(style: str) -> dict[str, tuple[str, bool]]:
    """Value and importance of each property; a later one counts unless an earlier one alone is important."""
    out: dict[str, tuple[str, bool]] = {}
    for part in style.split(";"):
        name, colon, value = part.partition(":")
        if colon:
            plain, name = re.sub(r"\s*!\s*important\s*$", "", value, flags=re.IGNORECASE), name.strip().lower()
            important = plain != value
            if important or not out.get(name, ("", False))[1]:
                out[name] = plain.strip().lower(), important
    return out
