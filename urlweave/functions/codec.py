"""Percent-encoding as column expressions.

A quoter cuts its text into runs of characters that stay, escapes, and single characters that are encoded; a text
of nothing but what stays is returned as it is. An unquoter cuts into escapes of well-formed UTF-8 characters, runs
of other characters and lone percent signs; escapes that are not well-formed UTF-8 stay as they are. Null gives null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

# RFC 3986 characters that are never encoded, and the further ones outside query strings.
ALWAYS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~!$'()*,"
NOT_IN_QUERY = "+&=;"

# What form encoding (the URL standard's application/x-www-form-urlencoded) leaves as it is; a space is a plus.
FORM_SAFE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._*"

_HEX = "[0-9A-Fa-f]"
_MORE = "%[89ABab]" + _HEX
# Well-formed UTF-8 (Unicode, table 3-7) in percent escapes, by number of bytes.
WELL_FORMED = "|".join([
    "%[0-7]" + _HEX,
    "%[Cc][2-9A-Fa-f]" + _MORE,
    "%[Dd]" + _HEX + _MORE,
    "%[Ee]0%[ABab]" + _HEX + _MORE,
    "%[Ee][1-9A-Ca-c]" + _MORE * 2,
    "%[Ee][Dd]%[89]" + _HEX + _MORE,
    "%[Ee][EeFf]" + _MORE * 2,
    "%[Ff]0%[9ABab]" + _HEX + _MORE * 2,
    "%[Ff][1-3]" + _MORE * 3,
    "%[Ff]4%8" + _HEX + _MORE * 2,
])


def char_class(chars: str) -> str:
    """The characters as the inside of a regular expression's class."""
    return "".join("\\" + c if re.match(r"[^A-Za-z0-9]", c) else c for c in chars)


def _escapes(chars: str) -> list[str]:
    return [f"%{ord(c):02X}" for c in chars]


def encode_utf8(text: Column) -> Column:
    """Every byte as an escape."""
    return F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "%$1")


def decode_utf8(escapes: Column) -> Column:
    return F.decode(F.unhex(F.replace(escapes, F.lit("%"), F.lit(""))), "UTF-8")


@dataclass(frozen=True)
class Quoter:
    """safe: further characters that stay; protected: stay, and stay encoded if they are; qs: space to plus; requote: the text has escapes."""

    safe: str = ""
    protected: str = ""
    qs: bool = False
    requote: bool = False

    @property
    def stays(self) -> str:
        return ALWAYS + ("" if self.qs else NOT_IN_QUERY) + self.safe + self.protected

    def __call__(self, text: Column) -> Column:
        return let(text, self._quoted)

    def _encoded(self, text: Column) -> Column:
        """A text without escapes: form encoding, whose escapes all stand for a byte, then the characters that stay put back."""
        out = F.url_encode(text)
        if not self.qs:
            out = F.replace(out, F.lit("+"), F.lit("%20"))
        for c in "".join(dict.fromkeys(self.stays)):
            if c not in FORM_SAFE:
                out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
        return out

    def _quoted(self, text: Column) -> Column:
        if not self.requote:
            return self._encoded(text)
        stays = char_class(self.stays)
        pieces = F.regexp_extract_all(text, F.lit(rf"(?:%{_HEX}{{2}})|[{stays}]+|[\s\S]"), F.lit(0))

        def piece(x: Column) -> Column:
            done = F.when(x.rlike(rf"^[{stays}]"), x)
            if self.qs:
                done = done.when(x == " ", F.lit("+"))
            upper = F.upper(x)
            plain = [e for e, c in zip(_escapes(self.stays), self.stays, strict=True) if c not in self.protected]
            done = done.when(x.rlike("^%.") & upper.isin(plain), decode_utf8(upper)).when(x.rlike("^%."), upper)
            return done.otherwise(encode_utf8(x))

        quoted = F.when(F.contains(text, F.lit("%")), F.array_join(F.transform(pieces, piece), "")).otherwise(self._encoded(text))
        return F.when(text.rlike(rf"^[{stays}]*\z"), text).otherwise(quoted)


@dataclass(frozen=True)
class Unquoter:
    """ignore, unsafe: characters that become escapes when decoded; qs: plus to space, delimiters stay encoded; plus: plus to space."""

    ignore: str = ""
    unsafe: str = ""
    qs: bool = False
    plus: bool = False

    def __call__(self, text: Column) -> Column:
        return let(text, self._unquoted)

    def _unquoted(self, text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(rf"(?:{WELL_FORMED})|[^%]+|%"), F.lit(0))
        again = [c for c in self.ignore + self.unsafe if c not in ALWAYS + NOT_IN_QUERY]
        if self.qs:
            again += [c for c in NOT_IN_QUERY if c not in again]
        spaced = (self.qs or self.plus) and "+" not in self.unsafe

        def literal(x: Column) -> Column:
            for c in self.unsafe:
                if c != "+":
                    x = F.replace(x, F.lit(c), F.lit(f"%{ord(c):02X}"))
            return F.replace(x, F.lit("+"), F.lit(" ")) if spaced else x

        def piece(x: Column) -> Column:
            upper = F.upper(x)
            done = F.when(~x.rlike("^%."), literal(x))
            if again:
                done = done.when(upper.isin(_escapes("".join(again))), upper)
            return done.otherwise(decode_utf8(upper))

        done = F.when(~F.contains(text, F.lit("%")), literal(text))
        if not again and self.unsafe in ("", "+"):
            # Form decoding does the same if all escapes are well-formed; it takes plus signs for spaces, too.
            plus = text if spaced else F.replace(text, F.lit("+"), F.lit("%2B"))
            done = done.when(~F.contains(F.regexp_replace(text, WELL_FORMED, ""), F.lit("%")), F.try_url_decode(plus))
        return done.otherwise(F.array_join(F.transform(pieces, piece), ""))


QUOTER = Quoter()
REQUOTER = Quoter(requote=True)
PATH_QUOTER = Quoter(safe="@:", protected="/+")
PATH_REQUOTER = Quoter(safe="@:", protected="/+", requote=True)
QUERY_QUOTER = Quoter(safe="?/:@", protected="=+&;", qs=True)
QUERY_REQUOTER = Quoter(safe="?/:@", protected="=+&;", qs=True, requote=True)
QUERY_PART_QUOTER = Quoter(safe="?/:@", qs=True)
FRAGMENT_QUOTER = Quoter(safe="?/:@")
FRAGMENT_REQUOTER = Quoter(safe="?/:@", requote=True)
UNQUOTER = Unquoter()
PATH_UNQUOTER = Unquoter(unsafe="+")
PATH_SAFE_UNQUOTER = Unquoter(ignore="/%", unsafe="+")
QS_UNQUOTER = Unquoter(qs=True)
UNQUOTER_PLUS = Unquoter(plus=True)
