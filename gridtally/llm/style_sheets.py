"""What the style sheets of a page and its ``style`` attributes display, as a wide screen would.

A scanner that knows nesting reads the rules that set ``display``, ``visibility`` or
``all``. Of the declarations that match an element the cascade picks one: importance, then
the ``style`` attribute, layers, specificity and order.

Blocks of ``@media``, ``@container`` and ``@supports`` count where their condition holds on
a screen of ``SCREEN`` pixels with a mouse; ``@layer`` and nested rules count, all other
blocks do not. Selectors: tags, classes, ids, attributes, all four combinators, ``:is``,
``:where``, ``:not``, places among siblings, ``:root``, ``:empty``, ``:link``, ``:checked``,
``:disabled``, ``:enabled``. Rules with other pseudo-classes (``:hover``, ``:target``) or
with pseudo-elements match nothing: they wait for an event or style no text of the page.
Sheets of other files are not read, scripts are not run, and ``var()`` is taken for unset.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

#: Width and height of the screen, in pixels.
SCREEN = (1920, 1080)
#: Selectors in more parentheses or blocks than this match nothing.
MAX_NESTING = 50

_TOKEN = re.compile(
    r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
    r"""|url\(\s*+[^"'\s)][^)]*+(?:\)|\Z)|\\.|[{};]""",
    re.S | re.I,
)
_DECIDES = re.compile("display|visibility|all", re.I)
_AT = re.compile(r"@([-\w]+)\s*(.*)\Z", re.S)
_IDENT = r"(?:[-\w\x80-\U0010ffff]|\\(?:[0-9a-fA-F]{1,6}\s?|[^\n0-9a-fA-F]))++"
_PIECE = re.compile(
    rf"""(?P<comma>\s*,\s*)|(?P<end>\s*\))|\s*(?P<combinator>[>+~])\s*|(?P<blank>\s+)
    |(?P<all>\*)|(?P<own>&)|\.(?P<cls>{_IDENT})|\#(?P<id>{_IDENT})
    |\[\s*(?P<attr>{_IDENT})\s*(?:(?P<op>[~|^$*]?=)\s*
        (?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>{_IDENT}))\s*(?P<flag>[iIsS])?\s*)?\]
    |(?P<colons>::?)(?P<pseudo>{_IDENT})(?P<open>\(\s*)?|(?P<tag>{_IDENT})""",
    re.X,
)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", re.S)
_NTH = re.compile(r"\s*(?:(even|odd)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*\)", re.I)
_WORD = re.compile(r"\(|\)|[^\s()]+")
_LENGTH = re.compile(r"([+-]?[\d.]+)\s*([a-z]*)\Z")
_PIXELS = {"": 1, "px": 1, "em": 16, "rem": 16, "pt": 4 / 3, "in": 96, "cm": 96 / 2.54, "mm": 96 / 25.4}

_DISPLAYED = set(
    "block inline inline-block flex inline-flex grid inline-grid flow-root contents list-item table "
    "inline-table table-row table-cell table-caption table-column table-column-group "
    "table-row-group table-header-group table-footer-group ruby ruby-base ruby-text run-in flow "
    "math -webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex".split()
)
#: What a value makes of display or visibility; None is the default or inherited one.
_DISPLAY = {"none": False, "revert": None, "revert-layer": None}
_DISPLAY |= dict.fromkeys(["initial", "unset", "inherit"], True)
_VISIBILITY = {"hidden": False, "collapse": False, "visible": True, "initial": True}
_VISIBILITY |= dict.fromkeys(["inherit", "unset", "revert", "revert-layer"])
_ALL = {"initial", "inherit", "unset", "revert", "revert-layer"}
_FEATURES = {
    "orientation": {"landscape"},
    "hover": {"", "hover"},
    "any-hover": {"", "hover"},
    "pointer": {"", "fine"},
    "any-pointer": {"", "fine"},
    "prefers-color-scheme": {"", "light"},
    "prefers-reduced-motion": {"no-preference"},
    "prefers-contrast": {"no-preference"},
    "scripting": {"", "enabled"},
    "update": {"", "fast"},
    "display-mode": {"browser"},
    "color": {""},
    "color-gamut": {"", "srgb"},
}
_COMPARED = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def declared(text: str) -> list[tuple[str, bool | None, bool]]:
    """Property, value and importance of a declaration that decides what is displayed."""
    name, _, value = text.partition(":")
    name = name.strip().lower()
    if name not in ("display", "visibility", "all"):
        return []
    value, bang, flag = (part.strip().lower() for part in value.partition("!"))
    important, out = bool(bang), []
    if important and flag != "important":
        return []
    if name == "display" or name == "all" and value in _ALL:
        if value in _DISPLAY:
            out.append(("display", _DISPLAY[value], important))
        elif value and (value.startswith("var(") or _DISPLAYED.issuperset(value.split())):
            out.append(("display", True, important))
    if name == "visibility" or name == "all" and value in _ALL:
        if value in _VISIBILITY or value.startswith("var("):
            out.append(("visibility", _VISIBILITY.get(value), important))
    return out


# Conditions


def _pixels(text: str) -> float | None:
    match = _LENGTH.match(text.strip())
    try:
        return float(match[1]) * _PIXELS[match[2]] if match else None
    except (KeyError, ValueError):
        return None


def _feature(text: str) -> bool:
    """Whether the screen has a media feature; unknown ones it has not."""
    name, colon, value = (part.strip() for part in text.partition(":"))
    sizes = dict(zip(("width", "height"), SCREEN))
    sizes |= {"inline-size": SCREEN[0], "block-size": SCREEN[1]}
    sizes |= {f"device-{name}": sizes[name] for name in ("width", "height")}
    if name in sizes and not colon:
        return True
    edge, _, size = name.partition("-")
    if colon and (edge in ("min", "max") and size in sizes or name in sizes):
        length = _pixels(value)
        if length is None:
            return False
        if name in sizes:
            return sizes[name] == length
        return sizes[size] >= length if edge == "min" else sizes[size] <= length
    if not colon and re.search("[<>=]", text):
        parts = [part.strip() for part in re.split("([<>]=?|=)", text)]
        values = [sizes.get(part, _pixels(part)) for part in parts[::2]]
        if None in values:
            return False
        return all(_COMPARED[o](a, b) for a, o, b in zip(values, parts[1::2], values[1:]))
    if re.fullmatch(r"(-webkit-)?(min-|max-)?(resolution|device-pixel-ratio)", name):
        match = re.match(r"([\d.]+)(dpi|dpcm|)", value)
        ratio = float(match[1]) / {"dpi": 96, "dpcm": 96 / 2.54}.get(match[2], 1) if match else 1
        return ratio <= 1 if "min-" in name else ratio >= 1 if "max-" in name else ratio == 1
    return value in _FEATURES.get(name, ())


def _supported(text: str) -> bool:
    return not text.lstrip().startswith(("-moz-", "-ms-"))


def _group(words: list[str], at: int) -> int:
    """The place behind the group that opens at ``at``."""
    depth = 0
    for place in range(at, len(words)):
        depth += (words[place] == "(") - (words[place] == ")")
        if depth == 0:
            return place + 1
    return len(words)


def _holds(words: list[str], leaf, depth: int = 0) -> bool:
    """Whether a condition of groups, ``not``, ``and`` and ``or`` holds."""
    if depth > MAX_NESTING:
        return False
    result, negate, joined, at = None, False, "and", 0
    while at < len(words):
        word = words[at]
        if word in ("and", "or"):
            joined = word
        elif word == "not":
            negate = not negate
        else:
            if word == "(":
                stop = _group(words, at)
                inside = words[at + 1 : stop - 1]
                if inside and inside[0] in ("(", "not"):
                    value = _holds(inside, leaf, depth + 1)
                else:
                    value = leaf(" ".join(inside))
                at = stop - 1
            elif at + 1 < len(words) and words[at + 1] == "(":
                # A function, as selector() of @supports.
                value, at = leaf(word), _group(words, at + 1) - 1
            else:
                value = word in ("all", "screen", "only")
            value, negate = value != negate, False
            result = value if result is None else result and value if joined == "and" else result or value
        at += 1
    return True if result is None else result


def media(query: str) -> bool:
    """Whether a list of media queries holds on the screen."""
    return any(_media(part) for part in query.lower().split(","))


def _media(query: str) -> bool:
    words = _WORD.findall(query)
    if words[:1] == ["not"] and words[1:2] != ["("]:
        # ``not`` before a media type negates the whole query.
        return not _holds(words[1:], _feature)
    return _holds(words, _feature)


# Selectors


def _plain(name: str) -> str:
    def one(match: re.Match) -> str:
        if not match[1]:
            return match[2]
        code = int(match[1], 16)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"

    return _ESCAPE.sub(one, name) if "\\" in name else name


@dataclass(eq=False)
class Selector:
    """Compounds from left to right, and the combinator in front of each."""

    compounds: list[list[tuple]] = field(default_factory=lambda: [[]])
    combinators: list[str] = field(default_factory=lambda: [""])
    weight: tuple[int, int, int] = (0, 0, 0)

    def add(self, test: tuple | None, *weight: int) -> None:
        if test:
            self.compounds[-1].append(test)
        self.weight = tuple(a + b for a, b in zip(self.weight, weight))


_PLACES = {
    "first-child": [("first", False)],
    "last-child": [("last", False)],
    "only-child": [("first", False), ("last", False)],
    "first-of-type": [("first", True)],
    "last-of-type": [("last", True)],
    "only-of-type": [("first", True), ("last", True)],
}
_NTHS = {
    "nth-child": ("first", False),
    "nth-last-child": ("last", False),
    "nth-of-type": ("first", True),
    "nth-last-of-type": ("last", True),
}
_STATES = {"root", "empty", "link", "any-link", "checked", "disabled", "enabled"}


def _heaviest(selectors: list[Selector]) -> tuple[int, int, int]:
    return max((s.weight for s in selectors), default=(0, 0, 0))


def _selectors(text: str, at: int, own: list[Selector] | None, depth: int) -> tuple[list[Selector], int]:
    """The selectors of a list up to its end or closing parenthesis, and the place behind."""
    out, one, known = [], Selector(), True

    def done() -> None:
        if known and all(one.compounds):
            out.append(one)

    if depth > MAX_NESTING:
        raise ValueError(text)
    while at < len(text):
        piece = _PIECE.match(text, at)
        if piece is None:
            raise ValueError(text)
        at, kind = piece.end(), piece.lastgroup
        if piece["comma"] is not None:
            done()
            one, known = Selector(), True
        elif piece["end"] is not None:
            if depth == 0:
                raise ValueError(text)
            done()
            return out, at
        elif piece["combinator"] or kind == "blank":
            if kind == "blank" and (at == len(text) or text[at] in ",)"):
                continue
            one.compounds.append([])
            one.combinators.append(piece["combinator"] or " ")
        elif kind == "all":
            one.add(("all",))
        elif kind == "own":
            one.add(("is", own) if own is not None else ("root",), *_heaviest(own or []))
        elif piece["cls"]:
            one.add(("class", _plain(piece["cls"])), 0, 1, 0)
        elif piece["id"]:
            one.add(("id", _plain(piece["id"])), 1, 0, 0)
        elif piece["attr"]:
            value = next((piece[g] for g in ("dq", "sq", "bare") if piece[g] is not None), "")
            same = (piece["flag"] or "").lower() == "i"
            one.add(("attr", _plain(piece["attr"]).lower(), piece["op"], _plain(value), same), 0, 1, 0)
        elif piece["tag"]:
            one.add(("tag", _plain(piece["tag"]).lower()), 0, 0, 1)
        else:
            name = piece["pseudo"].lower()
            if piece["colons"] == "::":
                known = False
            if name in ("is", "where", "not", "matches", "-webkit-any") and piece["open"]:
                inner, at = _selectors(text, at, own, depth + 1)
                weight = (0, 0, 0) if name == "where" else _heaviest(inner)
                one.add(("not" if name == "not" else "is", inner), *weight)
            elif name in _NTHS and piece["open"] and (nth := _NTH.match(text, at)):
                at = nth.end()
                if nth[1]:
                    step, first = 2, int(nth[1].lower() == "odd")
                elif nth[5]:
                    step, first = 0, int(nth[5])
                else:
                    step = int(nth[2] + "1" if nth[2] in ("", "+", "-") else nth[2])
                    first = int((nth[3] or "") + (nth[4] or "0"))
                one.add(("nth", *_NTHS[name], step, first), 0, 1, 0)
            elif name in _PLACES:
                for place in _PLACES[name]:
                    one.add(("nth", *place, 0, 1))
                one.add(None, 0, 1, 0)
            elif name in _STATES:
                one.add((name,), 0, 1, 0)
            else:
                known = False
                if piece["open"]:
                    at = _behind(text, at)
    # A parenthesis that is left open ends with the text.
    done()
    return out, at


def _behind(text: str, at: int) -> int:
    depth = 1
    while at < len(text) and depth:
        depth += (text[at] == "(") - (text[at] == ")")
        at += 1
    return at


def selectors(text: str, own: list[Selector] | None, depth: int) -> list[Selector]:
    """The selectors of a rule; inside a rule with selectors ``own`` they start there."""
    text = text.strip()
    if own is not None:
        # Without ``&`` a nested selector is a descendant.
        parts = _parts(text)
        text = ",".join(p if "&" in p else f"& {p.strip()}" for p in parts)
    try:
        return _selectors(text, 0, own, 0)[0] if depth <= MAX_NESTING else []
    except ValueError:
        return []


def _parts(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for at, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 0:
            out.append(text[start:at])
            start = at + 1
    return [*out, text[start:]]


@dataclass
class _Block:
    own: list[Selector] | None = None
    active: bool = True
    layer: tuple[float, ...] = ()


class Sheet:
    """The rules of a page that decide what is displayed."""

    def __init__(self, styles: list[str]):
        #: Rules by the id, class or tag that their last compound asks for.
        self.rules: dict[tuple, list[tuple]] = {}
        self.layers: dict[tuple, dict[str, int]] = {}
        self.order = 0
        self.matched: dict[tuple, bool] = {}
        for css in styles:
            if _DECIDES.search(css):
                self._read(css)

    def _read(self, css: str) -> None:
        blocks, text, start = [_Block()], [], 0
        for token in _TOKEN.finditer(css):
            if token[0].startswith("/*"):
                text.append(css[start : token.start()])
                start = token.end()
            elif token[0] in ("{", "}", ";"):
                text.append(css[start : token.start()])
                part, text, start = "".join(text).strip(), [], token.end()
                if token[0] == "{":
                    blocks.append(self._block(part, blocks))
                else:
                    self._declare(part, blocks[-1])
                    if token[0] == "}" and len(blocks) > 1:
                        blocks.pop()
        self._declare("".join(text) + css[start:], blocks[-1])

    def _block(self, prelude: str, blocks: list[_Block]) -> _Block:
        outer = blocks[-1]
        if not outer.active:
            return outer
        prelude = prelude.replace("<!--", "").replace("-->", "").strip()
        at = _AT.match(prelude)
        if not at:
            own = selectors(prelude, outer.own, len(blocks))
            return _Block(own, True, outer.layer)
        name, rest = at[1].lower(), at[2]
        layer, active = outer.layer, False
        if name == "media":
            active = not rest.strip() or media(rest)
        elif name == "supports":
            active = _holds(_WORD.findall(rest.lower()), _supported)
        elif name == "container":
            words = _WORD.findall(rest.lower())
            active = _holds(words[1:] if words[:1] not in (["("], ["not"]) else words, _feature)
        elif name == "layer":
            layer, active = self._layer(layer, rest.strip()), True
        return _Block(outer.own, active, layer)

    def _layer(self, outer: tuple, name: str) -> tuple:
        for part in name.split(".") if name else [f"\0{self.order}{len(self.layers)}"]:
            ranks = self.layers.setdefault(outer, {})
            outer = (*outer, ranks.setdefault(part.strip(), len(ranks)))
        return outer

    def _declare(self, text: str, block: _Block) -> None:
        if not block.active:
            return
        if text.startswith("@"):
            at = _AT.match(text)
            if at and at[1].lower() == "layer":
                for name in at[2].split(","):
                    self._layer(block.layer, name.strip())
            return
        if not block.own:
            return
        for name, value, important in declared(text):
            self.order += 1
            layer = (*block.layer, math.inf)
            for selector in block.own:
                ranks = tuple(-rank for rank in layer) if important else layer
                key = (important, False, ranks, selector.weight, self.order)
                self.rules.setdefault(_asked(selector), []).append((key, name, value, selector))

    def of(self, element) -> tuple[bool | None, bool | None]:
        """Whether an element is displayed and visible; None is the default."""
        best: dict[str, tuple] = {}
        attrs = element.attrs
        if "style" in attrs and _DECIDES.search(attrs["style"]):
            at = 0
            for text in _split(attrs["style"]):
                for name, value, important in declared(text):
                    at += 1
                    found = ((important, True, (), (0, 0, 0), at), value)
                    best[name] = max(best.get(name, found), found, key=lambda f: f[0])
        if self.rules:
            asked = [("tag", element.tag), ()]
            if "id" in attrs:
                asked.append(("id", attrs["id"]))
            if "class" in attrs:
                asked += [("class", name) for name in set(attrs["class"].split())]
            for key, name, value, selector in (r for a in asked for r in self.rules.get(a, ())):
                if (name not in best or key > best[name][0]) and self.matches(selector, element):
                    best[name] = (key, value)
        return tuple(best[name][1] if name in best else None for name in ("display", "visibility"))

    def any(self, of: list[Selector], element) -> bool:
        key = (id(of), element)
        if key not in self.matched:
            self.matched[key] = any(self.matches(selector, element) for selector in of)
        return self.matched[key]

    def matches(self, selector: Selector, element) -> bool:
        found = [element] if self.fits(selector.compounds[-1], element) else []
        for at in range(len(selector.compounds) - 1, 0, -1):
            if not found:
                return False
            seen, before, compound = set(), [], selector.compounds[at - 1]
            for start in found:
                for other in _reached(selector.combinators[at], start):
                    if other in seen:
                        break
                    seen.add(other)
                    if self.fits(compound, other):
                        before.append(other)
            found = before
        return bool(found)

    def fits(self, compound: list[tuple], element) -> bool:
        return all(self.passes(test, element) for test in compound)

    def passes(self, test: tuple, element) -> bool:
        kind, attrs = test[0], element.attrs
        if kind == "tag":
            return element.tag == test[1]
        if kind == "class":
            return test[1] in attrs.get("class", "").split()
        if kind == "id":
            return attrs.get("id") == test[1]
        if kind == "attr":
            return _has(attrs, *test[1:])
        if kind in ("is", "not"):
            return self.any(test[1], element) == (kind == "is")
        if kind == "nth":
            return _nth(element, *test[1:])
        if kind == "root":
            return element.parent is None
        if kind == "empty":
            return not element.children
        if kind in ("link", "any-link"):
            return element.tag in ("a", "area") and "href" in attrs
        if kind == "checked":
            return "checked" in attrs or "selected" in attrs
        if kind in ("disabled", "enabled"):
            able = element.tag in ("button", "input", "select", "textarea", "option", "optgroup", "fieldset")
            return able and ("disabled" in attrs) == (kind == "disabled")
        return True


def _split(style: str) -> list[str]:
    out, start = [], 0
    if "/*" in style:
        style = re.sub(r"/\*.*?(?:\*/|\Z)", "", style, flags=re.S)
    for token in _TOKEN.finditer(style):
        if token[0] == ";":
            out.append(style[start : token.start()])
            start = token.end()
    return [*out, style[start:]]


def _asked(selector: Selector) -> tuple:
    for kind in ("id", "class", "tag"):
        for test in selector.compounds[-1]:
            if test[0] == kind:
                return test
    return ()


def _has(attrs: dict[str, str], name: str, op: str | None, value: str, same: bool) -> bool:
    if name not in attrs or op is None:
        return name in attrs
    own = attrs[name]
    if same:
        own, value = own.lower(), value.lower()
    if op == "=":
        return own == value
    if op == "~=":
        return value in own.split()
    if op == "|=":
        return own == value or own.startswith(f"{value}-")
    if not value:
        return False
    return own.startswith(value) if op == "^=" else own.endswith(value) if op == "$=" else value in own


def _places(parent) -> tuple[list, dict]:
    """The child elements, and their places from both ends among all and among their tag."""
    if parent.places is None:
        kids = [child for child in parent.children if not isinstance(child, str)]
        tags, at = Counter(kid.tag for kid in kids), Counter()
        places = {}
        for number, kid in enumerate(kids):
            places[kid] = (number + 1, len(kids) - number, at[kid.tag] + 1, tags[kid.tag] - at[kid.tag])
            at[kid.tag] += 1
        parent.places = kids, places
    return parent.places


def _nth(element, end: str, of_type: bool, step: int, first: int) -> bool:
    if element.parent is None or element not in _places(element.parent)[1]:
        return True
    place = _places(element.parent)[1][element][2 * of_type + (end == "last")] - first
    return place == 0 if step == 0 else place % step == 0 and place // step >= 0


def _reached(combinator: str, element):
    """The elements that a combinator leads to, nearest first."""
    parent = element.parent
    if combinator in (" ", ">"):
        while parent is not None:
            yield parent
            parent = parent.parent if combinator == " " else None
    elif parent is not None:
        kids, places = _places(parent)
        at = places[element][0] - 1 if element in places else 0
        for place in range(at - 1, -1 if combinator == "~" else max(at - 2, -1), -1):
            yield kids[place]
