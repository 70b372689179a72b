"""The shape of a URL column, and the fixed values of URL syntax."""

from __future__ import annotations

#: What a URL column's schema says of it, as JSON Schema names the format. The column is a struct of five strings (scheme,
#: netloc, path, query, fragment), none of them null; "" is absence.
URL_METADATA = {"format": "uri"}

# Ports, and schemes by what they allow.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
HOST_SCHEMES = ("http", "https", "ws", "wss", "ftp")
RELATIVE_SCHEMES = ("", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss")
NETLOC_SCHEMES = (*RELATIVE_SCHEMES, "telnet", "snews", "rsync", "nfs", "git", "git+ssh", "itms-services")

#: Error codes of rows that are no URL, or can't be changed as asked.
ERRORS = {
    "BACKSLASH_IN_AUTHORITY": "a backslash in the authority",
    "INVALID_IPV6": "brackets that don't enclose the whole host",
    "INVALID_IPVFUTURE": "an IPvFuture address that is none",
    "BRACKET_NOT_IPV6": "brackets without a colon",
    "NFKC_DELIMITER": "a host character that normalises to a delimiter",
    "BAD_PORT": "a port that isn't a number",
    "PORT_RANGE": "a port outside 0-65535",
    "HOST_REQUIRED": "no host under a scheme that needs one",
    "HOST_DEFAULT_IGNORABLE": "an invisible character in the host",
    "HOST_INVALID_CHAR": "a character that a host can't have",
    "HOST_DELIM_AFTER_IDNA": "a host that encodes to one with delimiters",
    "HOST_IDNA": "a host that IDNA can't encode or decode",
    "ZONE_INVALID": "an empty zone or one with control characters",
    "PATH_NEEDS_SLASH": "a relative path after an authority",
    "NOT_ABSOLUTE": "no authority",
    "NO_SCHEME": "no scheme",
    "SCHEME_ON_RELATIVE": "a scheme that needs a host, for a URL without one",
    "EMPTY_HOST": "an empty host",
    "PATH_STARTS_SLASH": "an element that starts with a slash",
    "NAME_SLASH": "a slash in a name",
    "NAME_DOTS": "a name of one or two dots",
    "BAD_SUFFIX": "a suffix that doesn't start with a dot, is a dot or holds a slash",
    "EMPTY_NAME": "no name to give a suffix to",
}
