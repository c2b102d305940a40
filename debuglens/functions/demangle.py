"""Names of C++ symbols: operator names of old compilers and a part of the Itanium scheme.

A name that isn't understood is left as it is.
"""

from __future__ import annotations

import re

#: Codes of operators: their names after the word operator.
OPERATORS = {
    "nw": " new",
    "dl": " delete",
    "vn": " new []",
    "vd": " delete []",
    "as": "=",
    "ne": "!=",
    "eq": "==",
    "ge": ">=",
    "gt": ">",
    "le": "<=",
    "lt": "<",
    "pl": "+",
    "apl": "+=",
    "mi": "-",
    "ami": "-=",
    "ml": "*",
    "aml": "*=",
    "dv": "/",
    "adv": "/=",
    "md": "%",
    "amd": "%=",
    "aa": "&&",
    "oo": "||",
    "nt": "!",
    "pp": "++",
    "mm": "--",
    "or": "|",
    "aor": "|=",
    "er": "^",
    "aer": "^=",
    "ad": "&",
    "aad": "&=",
    "co": "~",
    "cl": "()",
    "ls": "<<",
    "als": "<<=",
    "rs": ">>",
    "ars": ">>=",
    "rf": "->",
    "vc": "[]",
    "cm": ", ",
    "cn": "?:",
    "mx": ">?",
    "mn": "<?",
    "rm": "->*",
}
#: Spelt names of the dollar scheme.
SPELT = {"plus": "+", "minus": "-", "mult": "*", "div": "/", "eq": "==", "ne": "!=", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "call": "()", "or": "|", "and": "&", "xor": "^", "compl": "~", "not": "!", "ls": "<<", "rs": ">>", "mod": "%"}
_BUILTIN = {"v": "void", "w": "wchar_t", "b": "bool", "c": "char", "a": "signed char", "h": "unsigned char", "s": "short", "t": "unsigned short", "i": "int", "j": "unsigned int", "l": "long", "m": "unsigned long", "x": "long long", "y": "unsigned long long", "n": "__int128", "o": "unsigned __int128", "f": "float", "d": "double", "e": "long double", "z": "..."}
_ITANIUM_OPERATORS = {"nw": "new", "na": "new[]", "dl": "delete", "da": "delete[]", "aS": "=", "pL": "+=", "mI": "-=", "mL": "*=", "dV": "/=", "pl": "+", "mi": "-", "ml": "*", "dv": "/", "eq": "==", "ne": "!=", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "nt": "!", "aa": "&&", "oo": "||", "pp": "++", "mm": "--", "cl": "()", "ix": "[]", "pt": "->", "ls": "<<", "rs": ">>", "an": "&", "or": "|", "eo": "^", "co": "~", "rm": "%", "cm": ",", "aN": "&=", "oR": "|=", "eO": "^=", "lS": "<<=", "rS": ">>=", "rM": "%="}
_SUBSTITUTES = {"t": "std", "a": "std::allocator", "b": "std::basic_string", "s": "std::string", "i": "std::istream", "o": "std::ostream", "d": "std::iostream"}


def _counted_name(text: str) -> str | None:
    m = re.fullmatch(r"(\d+)(.+)", text, re.S)
    return m[2] if m and len(m[2]) == int(m[1]) else None


def operator_name(mangled: str) -> str | None:
    """The operator that an old compiler's name stands for, None if it is no operator."""
    if m := re.fullmatch(r"op\$(assign_)?(\w+)", mangled):
        sign = SPELT.get(m[2])
        return f"operator{sign}{'=' if m[1] else ''}" if sign else None
    if mangled.startswith("type$"):
        name = _counted_name(mangled[5:])
        return f"operator {name}" if name else None
    if mangled.startswith("__op"):
        name = _counted_name(mangled[4:])
        return f"operator {name}" if name else None
    if mangled.startswith("__") and mangled[2:] in OPERATORS:
        return f"operator{OPERATORS[mangled[2:]]}"
    return None


class _Stop(Exception):
    pass


class _Itanium:
    """A reader of the part of the scheme without templates' finer points."""

    def __init__(self, text: str):
        self.s, self.i, self.subs = text, 0, []

    def eat(self, t: str) -> bool:
        if self.s.startswith(t, self.i):
            self.i += len(t)
            return True
        return False

    def source(self) -> str:
        m = re.compile(r"\d+").match(self.s, self.i)
        if not m:
            raise _Stop
        n = int(m[0])
        name = self.s[m.end() : m.end() + n]
        if len(name) != n:
            raise _Stop
        self.i = m.end() + n
        return "(anonymous namespace)" if name.startswith("_GLOBAL__N") else name

    def substitution(self) -> str:
        if m := re.compile(r"([0-9A-Z]*)_").match(self.s, self.i):
            k = int(m[1], 36) + 1 if m[1] else 0
            self.i = m.end()
            if k >= len(self.subs):
                raise _Stop
            return self.subs[k]
        c = self.s[self.i : self.i + 1]
        if c not in _SUBSTITUTES:
            raise _Stop
        self.i += 1
        return _SUBSTITUTES[c]

    def unqualified(self, within: str) -> str:
        if self.s[self.i : self.i + 1].isdigit():
            return self.source()
        two = self.s[self.i : self.i + 2]
        last = re.sub(r"<.*", "", within).rsplit("::", 1)[-1]
        if two in ("C1", "C2", "C3"):
            self.i += 2
            return last
        if two in ("D0", "D1", "D2"):
            self.i += 2
            return "~" + last
        if two == "cv":
            self.i += 2
            return "operator " + self.type()
        if two in _ITANIUM_OPERATORS:
            self.i += 2
            sign = _ITANIUM_OPERATORS[two]
            return "operator" + (" " if sign[0].isalpha() else "") + sign
        raise _Stop

    def arguments(self) -> str:
        out = []
        while not self.eat("E"):
            if self.eat("L"):
                kind = self.type()
                m = re.compile(r"n?\d+").match(self.s, self.i)
                if not m:
                    raise _Stop
                self.i = m.end()
                value = m[0].replace("n", "-")
                out.append({"int": value, "bool": {"0": "false", "1": "true"}.get(value, value), "unsigned int": value + "u", "long": value + "l", "unsigned long": value + "ul"}.get(kind, f"({kind}){value}"))
                if not self.eat("E"):
                    raise _Stop
            else:
                out.append(self.type())
        text = ", ".join(out)
        return f"<{text}{' ' if text.endswith('>') else ''}>"

    def nested(self) -> tuple[str, str]:
        tail = ""
        while (c := self.s[self.i : self.i + 1]) in ("r", "V", "K") and c:
            tail += {"r": " restrict", "V": " volatile", "K": " const"}[c]
            self.i += 1
        name = ""
        while not self.eat("E"):
            if self.eat("S"):
                name = self.substitution()
                continue
            if self.eat("I"):
                name += self.arguments()
                self.template = True
            else:
                part = self.unqualified(name)
                name = f"{name}::{part}" if name else part
                self.template = False
            if self.s[self.i : self.i + 1] != "E":
                self.subs.append(name)
        return name, tail

    template = False

    def name(self) -> tuple[str, str]:
        self.template = False
        if self.eat("N"):
            return self.nested()
        if self.eat("St"):
            name = "std::" + self.unqualified("std")
        elif self.eat("S"):
            name = self.substitution()
        else:
            name = self.unqualified("")
        if self.s[self.i : self.i + 1] == "I":
            self.subs.append(name)
            self.i += 1
            name += self.arguments()
            self.template = True
        return name, ""

    def type(self) -> str:
        c = self.s[self.i : self.i + 1]
        if c in _BUILTIN and c:
            self.i += 1
            return _BUILTIN[c]
        wraps = {"P": "*", "R": "&", "O": "&&", "K": " const", "V": " volatile"}
        if c in wraps and c:
            self.i += 1
            if c in "PRO" and self.s[self.i : self.i + 1] == "F":
                self.i += 1
                result = self.type()
                inner = self.parameters("E")
                self.subs += [f"{result} ({inner})", f"{result} ({wraps[c]})({inner})"]
                return self.subs[-1]
            out = self.type() + wraps[c]
            self.subs.append(out)
            return out
        if self.s.startswith("St", self.i) or c == "N" or c.isdigit():
            name, _ = self.name()
            self.subs.append(name)
            return name
        if c == "S":
            self.i += 1
            name = self.substitution()
            if self.eat("I"):
                name += self.arguments()
                self.subs.append(name)
            return name
        raise _Stop

    def parameters(self, end: str = "") -> str:
        out = []
        while self.i < len(self.s) and not (end and self.eat(end)):
            out.append(self.type())
        return "" if out == ["void"] else ", ".join(out)


def demangle(mangled: str, parameters: bool = True) -> str | None:
    """The name of an Itanium symbol, None if it isn't one or isn't understood."""
    if not mangled.startswith("_Z"):
        return None
    r = _Itanium(mangled[2:])
    special = {"TV": "vtable for ", "TI": "typeinfo for ", "TS": "typeinfo name for ", "TT": "VTT for "}
    try:
        for code, text in special.items():
            if r.eat(code):
                return text + r.type()
        if r.eat("GV"):
            return "guard variable for " + r.name()[0]
        name, tail = r.name()
        if r.i == len(r.s):
            return name
        result = f"{r.type()} " if r.template else ""  # template functions carry their return type
        inner = r.parameters()
        return f"{result}{name}({inner}){tail}" if parameters else name
    except (_Stop, RecursionError):
        return None
