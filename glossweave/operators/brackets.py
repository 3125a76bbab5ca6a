"""One pass over a source file: literals with what stands around them, from a tree of its brackets.

A file is cut into comments, literals, brackets and separators; what lies between two of these is a gap. Every open bracket
keeps its parent, the gap before it (what is called or indexed) and marks taken over from the parent or from the statement, so a
literal takes call, label, target and scope from its own gap and its innermost bracket: the work a literal costs does not depend
on how many stand before it or how deep it lies. Block comments may nest where the language has them so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: A line that ends so goes on in the next one.
GOES_ON = re.compile(r"(?:[=+,.?:&|<>(-]|\b(?:const|return|throw|new|is|case|or|and|not))[ \t\r]*$")
MEMBER = re.compile(r"([A-Za-z_][A-Za-z0-9_.]*)[ \t]*[:=][^A-Za-z]*$")
CALLED = re.compile(r"([A-Za-z_][A-Za-z0-9_.]*)[ \t]*$")
TERNARY = re.compile(r"\?\?|\?\.|[?:]")
BETWEEN = re.compile(r"[ \t\r\n]*")
BODY = re.compile(r"[ \t\r\n]*(?:async\*?|sync\*)?[ \t\r\n]*")
ARROW = re.compile(r"[ \t\r\n]*(?:async[ \t]*)?=>")


#: A gap that changes nothing.
NOTHING = (False, False, ())


def waiting(n: int, gap: str) -> int:
    """How many question marks wait for their colon after a gap, ``n`` before it."""
    for m in TERNARY.finditer(gap):
        if m[0] == "?":
            n += 1
        elif m[0] == ":":
            n = max(0, n - 1)
    return n


def call(*names: str) -> str:
    """Pattern of the gap before a call's bracket."""
    return r"(?:^|[^A-Za-z0-9_])(?:" + "|".join(names) + r")$"


@dataclass(frozen=True)
class Rule:
    """Where a pattern must fit for a literal to be of ``kind`` (None: no copy). Of several rules the first that fits counts.

    call: the literal is an argument, or an operand of one, right inside a bracket whose gap fits; later: the same, but not
    the first argument; index: the bracket's only content so far; inside: anywhere right inside such a bracket; within: any
    bracket around it in the same block; statement: a gap of its statement up to the literal; gap: the gap before it; after:
    the text behind it.
    """

    where: str
    pattern: str
    kind: str | None = None


class Bracket:
    """An open bracket. Files have many, so making one sets no more than it must."""

    __slots__ = ("opened", "parent", "head", "commas", "waiting", "marks", "words", "scope", "arrow", "statement", "fits", "scoping")

    def __init__(self, opened: str, parent: "Bracket | None", head: str, words: set, scope: bool, statement: int, marks: frozenset = frozenset(), fits: frozenset = frozenset()):
        self.opened, self.parent = opened, parent
        self.head = head            # the gap before the bracket
        self.commas = 0
        self.waiting = 0            # question marks that wait for their colon in this argument
        self.marks = marks          # rules of kind "within" that fit this or an outer bracket of the block
        self.words = words          # rules of kind "statement" that fit; shared with the brackets of the statement
        self.scope = scope          # inside a body of wanted parameters
        self.arrow = False          # such a body without brackets goes on
        self.statement = statement  # start of the statement
        self.fits = fits            # rules on calls and indexes that fit the head
        self.scoping = False        # holds the wanted parameters


@dataclass(frozen=True)
class Grammar:
    strings: tuple[str, ...]                # every literal shape, longest first
    rules: tuple[Rule, ...] = ()
    default: str | None = None              # kind of literals that no rule fits
    starts: str = "\"'/"                   # characters that a comment or literal may start with
    candidate: str = r"(?s)^\"(?:[^\"]|[^\"].*)\"$"
    skip: str | None = None                 # literals in which it fits are none
    comment: str = r"//[^\n]*"
    nested_comments: bool = False
    adjacent: bool = False                  # literals with blanks and comments between them are one
    blocked: tuple[tuple[str, str], ...] = ()  # (reason, statement pattern)
    scope: str | None = None                # parameters of the bodies whose literals may be rewritten
    out_of_scope: str = ""
    window: tuple[int, int] = (70, 70)      # context before and after
    whole_statement: int = 0                # context is the statement instead, of so many characters at most

    def compiled(self) -> "Reader":
        return Reader(self)


class Reader:
    """A grammar with its patterns compiled: made once a task."""

    def __init__(self, g: Grammar):
        self.g = g
        # plain code is passed over by one class; what starts like a token and is none is a character of its own (y)
        self.token = re.compile(
            "(?s)[^" + re.escape(g.starts) + r"()\[\]{},;\n]*+(?:(?P<o>[(\[{])|(?P<e>[)\]}])|(?P<x>[,;\n])|(?P<c>" + g.comment
            + r")|(?P<b>/\*)|(?P<s>" + "|".join(g.strings) + r")|(?P<y>.))")
        self.block = re.compile(r"/\*|\*/" if g.nested_comments else r"\*/")
        self.rules = [(r, re.compile(r.pattern)) for r in g.rules]
        self.judged = [(i, r.where, r.kind, p.match if r.where == "after" else p.search) for i, (r, p) in enumerate(self.rules)]
        self.within = [(i, p) for i, (r, p) in enumerate(self.rules) if r.where == "within"]
        self.statement = [(i, p) for i, (r, p) in enumerate(self.rules) if r.where == "statement"]
        self.statement += [(reason, re.compile(p)) for reason, p in g.blocked]
        # a sign behind no backslash, looked for by the sign
        self.candidate, self.skip = re.compile(g.candidate), re.compile(g.skip.replace(r"(?:^|[^\\])\$", r"\$(?<!\\\$)")) if g.skip else None
        self.scope = re.compile(g.scope) if g.scope else None
        self.heads: dict[tuple[str, str], tuple[frozenset, frozenset]] = {}
        self.gaps: dict[str, tuple[bool, bool, tuple]] = {}
        self.labels: dict[str, frozenset] = {}
        self.quote = re.compile(r"[#$@]*(\"\"\"|'''|[\"'`])")

    def about(self, opened: str, in_index: bool, head: str) -> tuple[frozenset, frozenset]:
        """(rules of kind "within", rules on calls and indexes) that fit the gap before a bracket. Most gaps recur in a file."""
        key = (opened + "[" * in_index, head)
        found = self.heads.get(key)
        if found is None:
            if len(self.heads) > 4096:
                self.heads.clear()
            full = "[" * in_index + head
            fits = frozenset(i for i, (r, p) in enumerate(self.rules) if r.where in ("call", "later", "index", "inside") and (r.where == "index") == (opened == "[") and p.search(head))
            found = self.heads[key] = (frozenset(i for i, p in self.within if p.search(full)), fits)
        return found

    def told(self, gap: str) -> tuple[bool, bool, tuple]:
        """(may change what waits for a colon, has the wanted parameters, statement rules that fit) of a gap; most recur in a file."""
        found = self.gaps.get(gap)
        if found is None:
            words = () if not gap or gap.isspace() else tuple(key for key, p in self.statement if p.search(gap))
            found = ("?" in gap or ":" in gap, bool(self.scope and self.scope.search(gap)), words)
            found = found if any(found) else NOTHING
            self.keep(self.gaps, gap, found)
        return found

    def labelled(self, gap: str) -> frozenset:
        """Rules on the gap before a literal that fit."""
        found = self.labels.get(gap)
        if found is None:
            found = frozenset(i for i, where, _, fits in self.judged if where == "gap" and fits(gap))
            self.keep(self.labels, gap, found)
        return found

    @staticmethod
    def keep(held: dict, gap: str, found) -> None:
        if len(gap) <= 256:
            if len(held) > 4096:
                held.clear()
            held[gap] = found

    def comment_end(self, text: str, at: int) -> int:
        depth = 1
        while depth:
            m = self.block.search(text, at)
            if not m:
                return len(text)
            depth += 1 if m[0] == "/*" else -1
            at = m.end()
        return at

    def inner(self, raw: str) -> str:
        """What stands between a literal's quotes."""
        m = self.quote.match(raw)
        return raw[m.end():len(raw) - len(m[1]) - (m.end() - len(m[1]) if raw[0] == "#" else 0)] if m else raw

    def read(self, text: str) -> Iterator[dict]:
        """A dict for each literal that is a candidate: start, length, line, raw, inner, kind, member, reason, context."""
        g, match = self.g, self.token.match
        OPEN, CLOSE, LAST, COMMENT, LITERAL, OTHER = (self.token.groupindex[x] for x in "oexcsy")
        BLOCK = self.token.groupindex["b"]
        node = Bracket("", None, "", set(), False, 0)
        at = gap_from = line_at = 0
        line, prev = 1, ""
        comments: list[tuple[int, int]] = []
        closed: Bracket | None = None      # the bracket closed just before
        starts, gaps = g.starts, self.gaps
        candidate, skip = self.candidate.search, self.skip.search if self.skip else lambda raw: None

        def gap_to(end: int) -> str:
            parts, begin = [], gap_from
            for a, b in comments:
                parts += [text[begin:a], "\n" if "\n" in text[a:b] else " "]
                begin = b
            return "".join(parts) + text[begin:end]

        def note(found: tuple[bool, bool, tuple], gap: str) -> None:
            """Ternaries, parameters and statement words of a gap."""
            asks, scoping, words = found
            if asks:
                node.waiting = waiting(node.waiting, gap)
            if scoping and node.opened == "(":
                node.scoping = True
            if words:
                node.words.update(words)

        while True:
            m = match(text, at)
            if m is None:
                return
            at, kind = m.end(), m.lastindex
            if kind <= LAST:
                start = at - 1
                what = text[start]
            elif kind == LITERAL:
                start = m.start(kind)
                what = text[start:at]
            else:
                if kind != OTHER:
                    at = at if kind == COMMENT else self.comment_end(text, at)
                    comments.append((m.start(kind), at))
                continue
            if what == "\n" and node.opened in ("(", "["):
                continue
            gap = gap_to(start) if comments else text[gap_from:start]
            if what == "\n":
                # the line goes on, or nothing has begun yet
                if prev not in ("s", ")", "]") and not gap.strip():
                    continue
                if GOES_ON.search(gap):
                    continue
                if self.continues(text, at):
                    continue
                found = gaps.get(gap) or self.told(gap)
                if found is not NOTHING:
                    note(found, gap)
                self.new_statement(node, at)
                gap_from, prev, closed = at, "", None
                if comments:
                    comments.clear()
                continue
            arrow = closed is not None and closed.scoping and ARROW.match(gap)
            asked = node.waiting
            if gap:
                found = gaps.get(gap) or self.told(gap)
                if found is not NOTHING:
                    note(found, gap)
            if arrow:
                node.arrow = True
            if kind == LITERAL:
                end, raws = at, [what]
                while g.adjacent:
                    to = end
                    while True:
                        to = BETWEEN.match(text, to).end()
                        # what starts no comment and no literal is neither
                        n = match(text, to) if text[to:to + 1] in starts else None
                        n = n if n and n.start(n.lastindex) == to else None
                        if n and n.lastindex == COMMENT:
                            to = n.end()
                        elif n and n.lastindex == BLOCK:
                            to = self.comment_end(text, n.end())
                        else:
                            break
                    if not (n and n.lastindex == LITERAL):
                        break
                    raws.append(n["s"])
                    end = n.end()
                if (candidate(what) and not skip(what)) if len(raws) == 1 else (all(map(candidate, raws)) and not any(map(skip, raws))):
                    line += text.count("\n", line_at, start)
                    line_at = start
                    found = self.judge(text, node, gap, prev, end, asked)
                    if found is not None:
                        reason = next((r for r, _ in g.blocked if r in node.words), None)
                        if reason is None and self.scope and not (node.scope or node.arrow):
                            reason = g.out_of_scope
                        member = MEMBER.search(gap) or (CALLED.search(node.head) if node.opened in ("(", "[") else None)
                        yield {
                            "start": start, "length": end - start, "line": line, "raw": text[start:end], "inner": self.inner(what) if len(raws) == 1 else "".join(map(self.inner, raws)),
                            "kind": found, "member": member[1] if member else "", "reason": reason, "context": self.context(text, node, start, end)}
                at, prev = end, "s"
            elif kind == OPEN:
                scope = node.scope or node.arrow
                if what == "{":
                    scope = scope or bool(closed and closed.scoping and BODY.fullmatch(gap))
                    node = Bracket(what, node, gap, set(node.words) if node.opened in ("(", "[") else set(), scope, at)
                else:
                    own, fits = self.about(what, prev == "[", gap)
                    node = Bracket(what, node, gap, node.words, scope, node.statement, node.marks | own if own else node.marks, fits)
                prev, closed = what, None
            elif kind == CLOSE:
                prev = what
                if node.parent is not None:
                    done, node = node, node.parent
                    if what == "}" and node.opened in ("", "{"):
                        self.new_statement(node, at)
                        prev = ""
                    closed = done if what == ")" else None
                else:
                    self.new_statement(node, at)
                    closed = None
                gap_from = at
                if comments:
                    comments.clear()
                continue
            else:
                prev = what
                if what == ",":
                    node.commas += 1
                    node.waiting, node.arrow = 0, False
                else:
                    self.new_statement(node, at)
            gap_from, closed = at, None
            if comments:
                comments.clear()

    @staticmethod
    def new_statement(node: Bracket, at: int) -> None:
        node.waiting, node.arrow = 0, False
        node.statement = at
        if node.opened in ("", "{"):
            node.words = set()
        else:
            node.words.clear()

    @staticmethod
    def continues(text: str, at: int) -> bool:
        """The next line starts with a member access, an operator or the body of the one before."""
        m = BETWEEN.match(text, at)
        return text[m.end():m.end() + 1] in (".", "?", "+", "{") and text[m.end():m.end() + 2] not in ("..", "++")

    def judge(self, text: str, node: Bracket, gap: str, prev: str, end: int, asked: int) -> str | None:
        """The kind by the first rule that fits."""
        tail = gap.rstrip(" \t\r\n") if gap else gap
        if tail.endswith(":"):
            # a colon belongs to a ternary if a question mark has waited for it
            operand = waiting(asked, tail[:-1]) > 0
        else:
            operand = tail.endswith(("+", "?", ",")) or (tail == "" and prev in ("(", "[", ",", ""))
        direct = tail == "" and prev == node.opened
        in_call = node.opened in ("(", "[")
        for i, w, kind, fits in self.judged:
            if w == "gap":
                hit = tail and i in (self.labels.get(gap) or self.labelled(gap))
            elif w == "after":
                hit = fits(text, end)
            elif w == "within":
                hit = i in node.marks
            elif w == "statement":
                hit = i in node.words
            else:
                hit = in_call and i in node.fits and (w == "inside" or (w == "index" and direct) or (operand and (w == "call" or (w == "later" and node.commas > 0))))
            if hit:
                return kind
        return self.g.default

    def context(self, text: str, node: Bracket, start: int, end: int) -> str:
        before, after = self.g.window
        if not self.g.whole_statement:
            return text[max(0, start - before):end + after]
        most = self.g.whole_statement
        to = text.find(";", end, end + most)
        return text[max(node.statement, start - most):(to + 1 if to >= 0 else min(len(text), end + after))]
