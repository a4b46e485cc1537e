"""Declarative selectors compiled to array expressions over shredded pages."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelweave.functions.transforms import empty_to_null, java_pattern, strip

Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Page:
    """Columns that hold one shredded page."""

    nodes: Column
    text: Column
    html: Column

    @staticmethod
    def columns() -> Page:
        return Page(F.col("nodes"), F.col("page_text"), F.col("html"))

    def node_text(self, node: Column) -> Column:
        inside = F.substring(self.text, node["text_from"] + 1, node["text_to"] - node["text_from"])
        return F.coalesce(strip(node["raw_text"]), inside)

    def node_html(self, node: Column) -> Column:
        return F.substring(self.html, node["html_from"] + 1, node["html_to"] - node["html_from"])


class SelectorError(ValueError):
    """The selector is no valid selector."""


class UnsupportedSelector(SelectorError):
    """The selector is valid, but asks for something that a stored page cannot tell or that is not built."""


# Fixed values of CSS: pseudo-classes that are valid but not supported here.
OTHER_PSEUDO_CLASSES = frozenset(
    "active any-link checked current default defined dir disabled enabled focus focus-visible focus-within "
    "future has host host-context hover in-range indeterminate is lang link local-link matches optional "
    "out-of-range past paused placeholder-shown playing read-only read-write required target "
    "target-within user-invalid visited where".split()
)
_STRING = r"\"[^\"]*\"|'[^']*'"
_NAME = r"[\w\-]|[^\x00-\x7f]|\\."
_SIMPLE = re.compile(
    rf"(?P<tag>\*|(?:{_NAME})+)"
    rf"|\#(?P<id>(?:{_NAME})+)"
    rf"|\.(?P<cls>(?:{_NAME})+)"
    rf"|\[\s*(?P<attr>[\w\-:]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<value>{_STRING}|[^\]\s]+)\s*)?\]"
    rf"|:(?:-soup-)?contains\(\s*(?P<text>{_STRING}|[^)]*)\s*\)"
    r"|:not\((?P<not>(?:[^()]|\([^()]*\))*)\)"
    r"|:(?P<pseudo>[a-zA-Z-]+)(?:\((?P<argument>[^()]*)\))?"
)
_BETWEEN = re.compile(r"\s*([>+~,])\s*|\s+")
_STEPS = re.compile(r"(?P<sign>[+-]?)(?P<a>\d*)n\s*(?:(?P<plus>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+)")


def _unquoted(text: str) -> str:
    return text[1:-1] if text[:1] in "\"'" and text[:1] == text[-1:] and len(text) > 1 else text


def _simple_test(page: Page, match: re.Match) -> Test:
    part = {k: v for k, v in match.groupdict().items() if v is not None}
    if "tag" in part:
        if part["tag"] == "*":
            return lambda n: F.lit(True)
        return lambda n: n["tag"] == part["tag"].lower()
    if "id" in part:
        wanted = re.sub(r"\\(.)", r"\1", part["id"])
        return lambda n: F.coalesce(n["attrs"]["id"] == wanted, F.lit(False))
    if "cls" in part:
        wanted = re.sub(r"\\(.)", r"\1", part["cls"])
        return lambda n: F.array_contains(n["classes"], wanted)
    if "text" in part:
        return lambda n: page.node_text(n).contains(_unquoted(part["text"]))
    if "not" in part:
        options = [_compound(page, option) for option in part["not"].split(",")]
        return lambda n: ~_any(options, n)
    if "pseudo" in part:
        return _pseudo_test(part["pseudo"].lower(), part.get("argument"))
    name, value = part["attr"].lower(), _unquoted(part.get("value", ""))
    operators: dict[str | None, Callable[[Column], Column]] = {
        None: lambda held: held.isNotNull(),
        "=": lambda held: held == value,
        "*=": lambda held: held.contains(value) if value else F.lit(False),
        "^=": lambda held: held.startswith(value) if value else F.lit(False),
        "$=": lambda held: held.endswith(value) if value else F.lit(False),
        "~=": lambda held: F.array_contains(F.split(held, r"\s+"), value),
        "|=": lambda held: (held == value) | held.startswith(f"{value}-"),
    }
    return lambda n: F.coalesce(operators[part.get("op")](n["attrs"][name]), F.lit(False))


def _any(options: list[Test], node: Column) -> Column:
    return functools.reduce(lambda a, b: a | b, [option(node) for option in options])


def _all(tests: list[Test], node: Column) -> Column:
    return functools.reduce(lambda a, b: a & b, [test(node) for test in tests])


def _compound(page: Page, css: str) -> Test:
    """Tests of one element without relations to others."""
    at, text, tests = 0, css.strip(), []
    while at < len(text):
        simple = _SIMPLE.match(text, at)
        if not simple:
            if _BETWEEN.match(text, at):
                raise UnsupportedSelector(f"relations inside :not() are not supported: {css!r}")
            raise SelectorError(f"selector {css!r} is not valid")
        tests.append(_simple_test(page, simple))
        at = simple.end()
    if not tests:
        raise SelectorError("an empty selector")
    return lambda n: _all(tests, n)


def _pseudo_test(name: str, argument: str | None) -> Test:
    """Places among siblings, and empty elements."""
    plain: dict[str, Test] = {
        "first-child": lambda n: n["nth"] == 1,
        "last-child": lambda n: n["nth"] == n["siblings"],
        "only-child": lambda n: n["siblings"] == 1,
        "first-of-type": lambda n: n["nth_of_type"] == 1,
        "last-of-type": lambda n: n["nth_of_type"] == n["siblings_of_type"],
        "only-of-type": lambda n: n["siblings_of_type"] == 1,
        "root": lambda n: n["parent"] == 0,
        "empty": lambda n: (n["post"] == n["pre"]) & (n["text_from"] == n["text_to"]),
    }
    counted: dict[str, Test] = {
        "nth-child": lambda n: n["nth"],
        "nth-last-child": lambda n: n["siblings"] - n["nth"] + 1,
        "nth-of-type": lambda n: n["nth_of_type"],
        "nth-last-of-type": lambda n: n["siblings_of_type"] - n["nth_of_type"] + 1,
    }
    if name in plain and argument is None:
        return plain[name]
    if name in counted and argument is not None:
        text = {"odd": "2n+1", "even": "2n"}.get(argument.strip().lower(), argument.strip().lower())
        steps = _STEPS.fullmatch(text)
        if steps:
            if steps["only"]:
                return lambda n: counted[name](n) == int(steps["only"])
            a = int(steps["sign"] + (steps["a"] or "1"))
            b = int((steps["plus"] or "") + (steps["b"] or "0"))
            if a == 0:
                return lambda n: counted[name](n) == b
            # place = a * k + b for some k of at least 0
            return lambda n: ((counted[name](n) - b) % a == 0) & ((counted[name](n) - b) * (1 if a > 0 else -1) >= 0)
        if " of " in text:
            raise UnsupportedSelector(f":{name}(... of ...) is not supported")
    if name in OTHER_PSEUDO_CLASSES:
        raise UnsupportedSelector(f":{name} is not supported")
    raise SelectorError(f":{name} is no pseudo-class")


def _read(page: Page, css: str) -> list[list[tuple[str, list[Test]]]]:
    """Alternatives, each a list of (relation to the previous step, tests)."""
    at, text = 0, css.strip()
    alternatives, relation, tests = [[]], "", []

    def step() -> None:
        if not tests:
            raise SelectorError(f"selector {css!r} is not valid")
        alternatives[-1].append((relation, tests))

    while at < len(text):
        simple = _SIMPLE.match(text, at)
        if simple:
            tests.append(_simple_test(page, simple))
            at = simple.end()
            continue
        between = _BETWEEN.match(text, at)
        if not between:
            raise SelectorError(f"selector {css!r} is not valid at {text[at:]!r}")
        step()
        relation, tests = between.group(1) or " ", []
        if relation == ",":
            alternatives.append([])
            relation = ""
        at = between.end()
    step()
    return alternatives


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is referred to."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _at(values: Column, place: Column) -> Column:
    """Value for the element of a place, which counts from 1; null for place 0."""
    return F.get(values, place - 1)


def _chained(page: Page, ends: Column, pointer: str) -> Column:
    """For every element, whether one is flagged among those that its pointers lead to, one after the other.

    Pointers are followed by doubling: each round adds what the element a pointer leads to has found and takes
    over its pointer, so rounds grow with the logarithm of the longest chain; after the last pointer they do nothing.
    """
    start = F.transform(
        page.nodes,
        lambda n: F.struct(F.coalesce(_at(ends, n[pointer]) > 0, F.lit(False)).alias("hit"), F.coalesce(n[pointer], F.lit(0)).alias("to")),
    )

    def round_of(states: Column) -> Column:
        def step(state: Column) -> Column:
            target = _at(states, state["to"])
            return F.when(state["to"] > 0, F.struct((state["hit"] | target["hit"]).alias("hit"), target["to"].alias("to"))).otherwise(state)

        return F.when(F.exists(states, lambda state: state["to"] > 0), F.transform(states, step)).otherwise(states)

    most = F.sequence(F.lit(0), F.ceil(F.log2(F.size(page.nodes) + 1)).cast("int"))
    return F.transform(F.aggregate(most, start, lambda states, _: round_of(states)), lambda state: state["hit"])


#: Elements of a block, as a power of two.
_BLOCK = 6


def _inside(ends: Column, use: Callable[[Test], Column]) -> Column:
    """``use`` of the test whether an element lies inside a flagged one.

    Elements lie in document order, so one does if a flagged one before it ends there or later. The latest end
    before each block of elements is worked out once; an element looks there, then at those before it in its block.
    """
    blocks = F.sequence(F.lit(0), F.shiftright(F.size(ends), _BLOCK))
    latest = F.transform(blocks, lambda block: F.array_max(F.slice(ends, F.shiftleft(block, _BLOCK) + 1, F.lit(1 << _BLOCK))))
    before = bound(latest, lambda by_block: F.transform(blocks, lambda block: F.array_max(F.slice(by_block, F.lit(1), block))))

    def test(by_block: Column, n: Column) -> Column:
        block = F.shiftright(n["pre"] - 1, _BLOCK)
        begin = F.shiftleft(block, _BLOCK) + 1
        near = F.array_max(F.slice(ends, begin, n["pre"] - begin))
        return F.coalesce(F.get(by_block, block) >= n["pre"], F.lit(False)) | F.coalesce(near >= n["pre"], F.lit(False))

    return bound(before, lambda by_block: use(lambda n: test(by_block, n)))


def _after(page: Page, ends: Column, use: Callable[[Test], Column]) -> Column:
    """``use`` of the test whether a flagged sibling lies before an element."""
    return bound(_chained(page, ends, "prev"), lambda by_place: use(lambda n: _at(by_place, n["pre"])))


# ``use`` of the test whether a flagged element stands in the relation to an element. For every element there is
# the position of its last descendant if it is flagged, else 0.
_RELATIONS: dict[str, Callable[[Page, Column, Callable[[Test], Column]], Column]] = {
    " ": lambda page, ends, use: _inside(ends, use),
    ">": lambda page, ends, use: use(lambda n: _at(ends, n["parent"]) > 0),
    "+": lambda page, ends, use: use(lambda n: _at(ends, n["prev"]) > 0),
    "~": _after,
}


def _related(page: Page, steps: list[tuple[str, list[Test]]], use: Callable[[Test], Column]) -> Column:
    """``use`` of the test whether an element matches the last step; earlier steps are flags by place.

    Relations are looked up only for elements that pass the tests of their own.
    """
    relation, tests = steps[-1]
    if len(steps) == 1:
        return use(lambda n: _all(tests, n))
    ends = _related(page, steps[:-1], lambda test: F.transform(page.nodes, lambda n: F.when(test(n), n["post"]).otherwise(0)))
    return bound(ends, lambda earlier: _RELATIONS[relation](page, earlier, lambda near: use(lambda n: _all([*tests, near], n))))


def select_css(page: Page, css: str) -> Column:
    """Matching elements in document order."""
    options = _read(page, css)

    def any_of(rest: list, tests: list[Test]) -> Column:
        if not rest:
            return F.filter(page.nodes, lambda n: functools.reduce(Column.__or__, [F.coalesce(test(n), F.lit(False)) for test in tests]))
        return _related(page, rest[0], lambda test: any_of(rest[1:], [*tests, test]))

    return any_of(options, [])


def xpath_to_css(xpath: str) -> str | None:
    """Three accepted forms: by id, by class, else every element named in the first step."""
    if xpath.startswith("//"):
        for attribute, sign in (("id", "#"), ("class", ".")):
            found = re.search(rf'\[@{attribute}="([^"]+)"\]', xpath)
            if found:
                return sign + found.group(1)
    tag = re.search(r"//(\w+)", xpath)
    return tag.group(1) if tag else None


def select(page: Page, selector: str, kind: str = "css") -> Column:
    """Matching elements in document order; none for an invalid selector.

    A valid selector that is not supported raises ``UnsupportedSelector`` when the plan is built.
    """
    css = xpath_to_css(selector) if kind == "xpath" else selector
    try:
        return select_css(page, css or "")
    except UnsupportedSelector:
        raise
    except SelectorError:
        return F.filter(page.nodes, lambda n: F.lit(False))


def select_regex(page: Page, pattern: str) -> Column:
    """Texts found in the page source: the first group if there is one, else the whole match."""
    group = 1 if re.compile(pattern).groups else 0
    found = F.regexp_extract_all(page.html, F.lit(java_pattern(f"(?im){pattern}")), F.lit(group))
    return F.transform(found, strip)


def node_value(page: Page, node: Column, attr: str | None) -> Column:
    if attr is None or attr == "text":
        return page.node_text(node)
    if attr == "html":
        return page.node_html(node)
    return F.coalesce(node["attrs"][attr.lower()], F.lit(""))


def pick(values: Column, index: int) -> Column:
    """Element by zero-based position, from the end when negative; null when out of range."""
    return F.try_element_at(values, F.lit(index if index < 0 else index + 1))


def extract(page: Page, config: Mapping) -> Column:
    """Value of one configured selector, null when nothing matches."""
    selector, index = config.get("selector"), config.get("index", 0)
    if not selector:
        return F.lit(None).cast("string")
    if config.get("type", "css") == "regex":
        return pick(select_regex(page, selector), index)
    node = pick(select(page, selector, config.get("type", "css")), index)
    return bound(node, lambda n: F.when(n.isNotNull(), node_value(page, n, config.get("attr"))))


def extract_all(page: Page, config: Mapping) -> Column:
    """Values of all matching elements in document order; a missing attribute gives an empty one."""
    selector = config.get("selector")
    if not selector:
        return F.array().cast("array<string>")
    if config.get("type", "css") == "regex":
        return select_regex(page, selector)
    nodes = select(page, selector, config.get("type", "css"))
    return F.transform(nodes, lambda n: node_value(page, n, config.get("attr")))


def extract_fields(page: Page, selectors: Mapping[str, Mapping]) -> list[Column]:
    """One column per named selector; empty values count as absent."""
    return [empty_to_null(extract(page, config)).alias(name) for name, config in selectors.items()]
