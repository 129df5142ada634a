"""Pages as light trees: only the elements that decide about text have nodes, and text lies between them in page order.

Reads what browsers read: void elements, end tags left out, comments and raw text that do not end, tags that close one
another. One pass, no recursion, time in proportion to the page.
"""

from __future__ import annotations

import html
import re

import xxhash

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("audio button canvas datalist head iframe map meter noembed noframes noscript object optgroup option output progress script select style svg template textarea title video".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
FURNITURE = frozenset("nav footer aside dialog menu search form header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCKS - frozenset("body caption html legend tbody td tfoot th thead tr".split())
#: An element in the first set is closed by a start tag of the second that comes within the bounds of the third.
CLOSES = {name: (closed, bounds) for names, closed, bounds in (("li", ("li",), ("ul", "ol", "menu", "dir")), ("dt dd", ("dt", "dd"), ("dl",)), ("tr", ("tr",), ("table",)), ("td th", ("td", "th"), ("table",)), ("thead tbody tfoot", ("thead", "tbody", "tfoot"), ("table",)), ("option", ("option",), ("select",)), ("optgroup", ("optgroup", "option"), ("select",))) for name in names.split()}
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SCOPES = frozenset("caption html marquee object table td template th".split())

#: Words of class, id and role that name what surrounds an article.
HINTS = frozenset("ad ads adbox adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs captcha comment comments contentinfo complementary consent cookie cookies disqus footer form gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion related recommended replies respond share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget widgets".split())
#: Before a hint these turn it into a remark on the layout.
NOT_HINTS = frozenset("has have no not with without hide hides is".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(?![\"'])([^\s>]*)))?")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """names, parents: of the nodes, parents first; flags: why a node is no text; texts: (node, text, in a link).

    A None text is the border of a block. digests: of what is in a node, text and tags, for nodes that are blocks.
    """

    __slots__ = ("names", "parents", "flags", "mains", "digests", "texts")

    def __init__(self, source: str):
        self.names, self.parents, self.flags, self.mains, self.digests, self.texts = ["html"], [-1], [""], [False], [0], []
        self._read(source)

    def _read(self, source: str) -> None:
        names, parents, flags, mains, digests, texts = self.names, self.parents, self.flags, self.mains, self.digests, self.texts
        # open elements: their name and node; an element without a node of its own has that of the one around it
        open_names, open_nodes, places = ["html"], [0], {"html": [0]}
        parts: list[list[str]] = [["html"]]  # of the open nodes, what their digest is made of
        node, links, at, size, last_block, scopes = 0, 0, 0, len(source), [0], [0]

        def pop_to(place: int) -> None:
            nonlocal node, links
            while len(open_names) > place:
                name, own = open_names.pop(), open_nodes.pop()
                places[name].pop()
                links -= name == "a"
                if last_block[-1] == len(open_names):
                    last_block.pop()
                if scopes[-1] == len(open_names):
                    scopes.pop()
                if own != open_nodes[-1]:
                    inner = parts.pop()
                    if len(inner) > 1:
                        digests[own] = xxhash.xxh64_intdigest("\x00".join(inner)) - 2**63
                        parts[-1].append(f"\x01{digests[own]:x}")
                    if names[own] in BLOCKS:
                        texts.append((own, None, False))
            node = open_nodes[-1]

        def place_of(name: str) -> int:
            found = places.get(name)
            return found[-1] if found else -1

        def text(value: str) -> None:
            if flags[node] == "silent" and names[node] == "head" and value.strip():
                pop_to(place_of("head"))
            value = html.unescape(value) if "&" in value else value
            texts.append((node, value, links > 0))
            if slim := " ".join(value.split()):
                parts[-1].append(slim)

        while at < size:
            tag = source.find("<", at)
            if tag < 0:
                text(source[at:])
                break
            if tag > at:
                text(source[at:tag])
            after = source[tag + 1 : tag + 2]
            closing = after == "/"
            found = _NAME.match(source, tag + 1 + closing)
            if found is None:
                if source.startswith("<!--", tag):
                    end = tag + 5 if source.startswith("<!-->", tag) else tag + 6 if source.startswith("<!--->", tag) else -1
                    if end < 0:
                        ends = [e for e in (_after(source, "-->", tag + 4), _after(source, "--!>", tag + 4)) if e >= 0] if "--!>" in source else [_after(source, "-->", tag + 4)]
                        end = min(ends, default=-1)
                    at = size if end < 0 else end
                elif after in ("!", "?") or closing and tag + 2 < size:
                    end = source.find(">", tag)
                    at = size if end < 0 else end + 1
                else:
                    text("<")
                    at = tag + 1
                continue
            name, at = found[0].lower(), found.end()
            attributes: dict[str, str] = {}
            while at < size and source[at] != ">":
                one = _ATTRIBUTE.match(source, at)
                if one is None:  # white space or a slash before the end
                    at = source.find(">", at)
                    at = size if at < 0 else at
                    break
                at = one.end()
                value = next((v for v in one.groups()[1:] if v is not None), "")
                attributes.setdefault(one[1].lower(), value)
                rest = source[at : at + 64].lstrip()
                if rest[:1] == "=" and rest[1:].lstrip()[:1] in ('"', "'"):
                    at = size  # a quotation that does not end takes the rest of the page with it
            if at >= size:
                break  # so does a tag
            at += 1
            if closing:
                if name == "br":
                    text(" ")
                elif name in HEADINGS:
                    if (place := max(map(place_of, HEADINGS))) > scopes[-1]:
                        pop_to(place)
                elif name == "p" and place_of("p") <= scopes[-1]:
                    texts.append((node, None, False))
                elif name not in ("html", "body") and (place := place_of(name)) > 0 and (place > scopes[-1] or name in SCOPES) and (name in BLOCKS or name in SILENT or place > last_block[-1]):
                    pop_to(place)
                continue
            if name in ("html", "body", "head") and (name == "html" or place_of(name) >= 0 or name == "head" and place_of("body") >= 0):
                continue
            if place_of("head") >= 0 and name not in IN_HEAD and name != "head":
                pop_to(place_of("head"))
            if name in ENDS_P and (place := place_of("p")) > max(scopes[-1], place_of("button")):
                pop_to(place)
            if name in CLOSES:
                closed, bounds = CLOSES[name]
                if (place := max(map(place_of, closed))) > max(map(place_of, bounds)):
                    pop_to(place)
            elif name in HEADINGS and open_names[-1] in HEADINGS:
                pop_to(len(open_names) - 1)
            elif name == "a" and place_of("a") > last_block[-1]:
                pop_to(place_of("a"))
            if name == "br":
                text(" ")
            if name in VOID:
                if name == "hr":
                    texts.append((node, None, False))
                continue
            flag = "silent" if name in SILENT or "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower() else _flag(name, attributes)
            block = name in BLOCKS
            places.setdefault(name, []).append(len(open_names))
            if block:
                last_block.append(len(open_names))
                texts.append((node, None, False))
            if name in SCOPES:
                scopes.append(len(open_names))
            open_names.append(name)
            links += name == "a"
            if block or flag:
                names.append(name)
                parents.append(node)
                flags.append(flag)
                mains.append(name in ("article", "main") or attributes.get("role", "").lower() in ("article", "main") or attributes.get("itemprop") == "articleBody")
                digests.append(0)
                node = len(names) - 1
                parts.append([f"{name} {attributes.get('class', '')} {attributes.get('id', '')}"])
            open_nodes.append(node)
            if name in RAW:
                end = _ENDS[name].search(source, at)
                at = end.start() if end else size
            elif name == "plaintext":
                text(source[at:])
                break
        pop_to(1)
        inner = parts.pop()
        digests[0] = xxhash.xxh64_intdigest("\x00".join(inner)) - 2**63


def _after(source: str, what: str, at: int) -> int:
    found = source.find(what, at)
    return found if found < 0 else found + len(what)


def _flag(name: str, attributes: dict[str, str]) -> str:
    """What an element is by its name ("tag") or by its class, id, role and label ("hint"); nothing for text."""
    if name in FURNITURE:
        return "header" if name == "header" else "tag"
    if name in ("html", "body", "article", "main") and not attributes:
        return ""
    for key in ("class", "id", "role"):
        for group in attributes.get(key, "").split():
            words = [w.lower() for w in _WORDS.findall(group)]
            for before, word in zip(["", *words], words, strict=False):
                if word in HINTS and before not in NOT_HINTS:
                    return "header" if word == "header" else "hint"
    return ""
