"""Objects inside JSON texts as labelled steps."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}
_BAD = object()


def _constant(name: str):
    raise ValueError(name)


def _parse_flat(text: str):
    """As ``json.loads``, but without recursion, for texts nested deeper than
    the interpreter's stack."""
    stack: list = []  # open containers; for objects with the key in hand
    keys: list = []
    at, want = _SPACE.match(text).end(), "value"
    root = _BAD
    while True:
        c = text[at : at + 1]
        if want == "value" or want == "first":
            if want == "first" and c == ("]" if isinstance(stack[-1], list) else "}"):
                value, at = stack.pop(), at + 1
                keys.pop()
            elif want == "first" and isinstance(stack[-1], dict):
                want = "key"
                continue
            elif c == '"':
                value, at = scanstring(text, at + 1, True)
            elif c in ("{", "["):
                stack.append({} if c == "{" else [])
                keys.append(None)
                at, want = _SPACE.match(text, at + 1).end(), "first"
                continue
            elif word := next((w for w in _WORDS if text.startswith(w, at)), None):
                value, at = _WORDS[word], at + len(word)
            elif m := _NUMBER.match(text, at):
                value, at = json.loads(m.group()), m.end()
            else:
                raise ValueError(f"value expected at {at}")
        elif want == "key":
            if c != '"':
                raise ValueError(f"key expected at {at}")
            keys[-1], at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"colon expected at {at}")
            at, want = _SPACE.match(text, at + 1).end(), "value"
            continue
        at = _SPACE.match(text, at).end()
        if not stack:
            root = value
            break
        if isinstance(stack[-1], list):
            stack[-1].append(value)
        else:
            stack[-1][keys[-1]] = value
        c = text[at : at + 1]
        if c == ",":
            at = _SPACE.match(text, at + 1).end()
            want = "value" if isinstance(stack[-1], list) else "key"
        elif c and c == ("]" if isinstance(stack[-1], list) else "}"):
            want = "first"  # the container is closed as an empty one would be
        else:
            raise ValueError(f"comma expected at {at}")
    if at != len(text):
        raise ValueError(f"more text at {at}")
    return root


def parse(text: str | None):
    """The value of a JSON text by the standard (no NaN, no trailing text);
    ``unreadable`` for anything else. Of repeated keys the last counts."""
    if text is None:
        return unreadable
    try:
        return json.loads(text, parse_constant=_constant)
    except RecursionError:
        try:
            return _parse_flat(text)
        except (ValueError, IndexError):
            return unreadable
    except ValueError:
        return unreadable


class _Unreadable:
    pass


unreadable = _Unreadable()


def objects(nodes: list[str | None]) -> list[tuple[list[str], list[str], list[str], list[tuple[str, str]]]]:
    """Every non-empty object at any depth, in document order, as (steps,
    ordinals, keys, scalars). ``steps`` has one element for each enclosing
    object and the object itself: the keys and positions that lead from the
    one to the next, joined by ``/``. ``ordinals`` is the Dewey label: the
    place among the members in source order, likewise by object. ``keys`` are
    the keys of the steps alone. ``scalars`` are the object's members that are
    no containers, as JSON texts; lists of scalars count as one text."""
    out = []
    for position, text in enumerate(nodes):
        value = parse(text)
        if not isinstance(value, (dict, list)):
            continue
        stack = [(value, (), (), (), str(position), str(position), "")]
        while stack:
            value, steps, ordinals, keys, step, ordinal, key = stack.pop()
            children = []
            if isinstance(value, dict):
                if not value:
                    continue
                steps, ordinals, keys = (*steps, step), (*ordinals, ordinal), (*keys, key)
                scalars = []
                for n, (k, v) in enumerate(value.items()):
                    if isinstance(v, dict) or isinstance(v, list) and _holds_object(v):
                        children.append((v, steps, ordinals, keys, k, str(n), k))
                    else:
                        scalars.append((k, json.dumps(v, ensure_ascii=False) if not isinstance(v, list) else _dump(v)))
                out.append((list(steps), list(ordinals), list(keys), scalars))
            else:
                children = [(v, steps, ordinals, keys, f"{step}/{n}", f"{ordinal}.{n}", key) for n, v in enumerate(value) if isinstance(v, (dict, list))]
            stack.extend(reversed(children))
    return out


def _dump(value: list) -> str:
    """A list without objects as JSON text, nested to any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        out, todo = [], [(value, "")]
        while todo:
            v, before = todo.pop()
            out.append(before)
            if v is _BAD:
                out.append("]")
            elif isinstance(v, list):
                out.append("[")
                todo.append((_BAD, ""))
                todo.extend((x, ", " if i else "") for i, x in reversed(list(enumerate(v))))
            else:
                out.append(json.dumps(v, ensure_ascii=False))
        return "".join(out)


def _holds_object(value: list) -> bool:
    todo = [value]
    while todo:
        for v in todo.pop():
            if isinstance(v, dict):
                return True
            if isinstance(v, list):
                todo.append(v)
    return False
