"""Problem 6: credentials in source code and configuration, and masking them.

Literals that stand by a credential's name, in a URL or header, after a telling word in a comment, or that have the form
of a known provider's token are credentials unless they are placeholders, references, ids or digests. Private keys are
told by their markers and by the binary grammar of their containers (DER, the OpenSSH format). Literals that decode
(base64, hex, percent, escapes; layer by layer) to text are scanned again, and what is found inside makes the enclosing
literal the credential. Masking replaces letters and digits of a credential one by one, so that quotes, escapes, lengths
and line ends stay and the file parses as before.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed: names of credentials, as sequences of words.
PHRASES = re.compile(
    r"(?<![a-z])(?:pass ?word|pass ?wd|pwd|pass ?phrase|(?:admin|user|root|db|ftp|smtp|sudo|login) pass|secret|token|api ?key|(?:access|auth|signing|encryption|private|secret|master|account|shared|session|service|deploy|storage) key|"
    r"credentials?|dsn|kennwort|passwort|contrase[nñ]a|mot de passe)(?![a-z])"
)
#: Fixed: words that make a name speak of something else if they come right after the credential's, or right before.
OTHER = frozenset("label hint path id ids digest sha sha1 sha256 sha512 md5 checksum hash fingerprint integrity name length size count ttl expiry expires url uri endpoint file dir public help message text title type format prefix regex rows".split())
DIGESTS = frozenset(("digest", "revision", "sha", "sha1", "sha256", "sha512", "checksum", "hash", "fingerprint", "integrity", "commit"))
DIGEST = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128})(?![0-9A-Za-z])")
#: Calls that take the coded form of something else.
DECODED = re.compile(r"(?:fromhex|unhexlify|b64decode|Buffer\.from|DecodeString|atob)\(")
BEFORE = frozenset(("public", "max", "min", "no"))
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zñ]+|\d+")
NAME = re.compile(r"[A-Za-z_][\w.-]*")
HOT = re.compile(r"pass|pwd|secret|token|key\b|key_|apikey|api-key|[a-z]Key|KEY|credential|CREDENTIAL|dsn|DSN|kennwort|contrase|mot de passe|authorization|bearer|\blogin\b|curl\b", re.I)
STRING = re.compile(r"""("{3}|'{3})([\s\S]*?)\1|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`""")
QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`')
BARE = re.compile(r"^\s*(?:export\s+|set\s+|-\s+)?[\"']?([A-Za-z_][\w.-]*)[\"']?\s*[:=]\s*([^\s\"'`#,;{\[]\S*)\s*(?:\s[#;].*)?$")
PROVIDER = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abprs]-[\w-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{16,}"
    r"|pypi-[\w-]{16,}|hf_[A-Za-z0-9]{20,}|AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|key-[A-Za-z0-9]{24,}|eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,})"
)
STARTS = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_(?:live|test)_|npm_|pypi-|hf_|AIza|SG\.|eyJ|key-")
LOGIN = re.compile(r"\b[a-z][a-z0-9+.-]*://([^\s:/@\"'`]*):([^\s@\"'`/]+)@[\w.$%{-]+", re.I)
HEADER = re.compile(r"\b(Bearer|Basic|Token)\s+([A-Za-z0-9+/_.~=-]{8,})")
CURL = re.compile(r"\bcurl\b.*?\s(?:-u|--user)\s*[\"']?([\w.@-]+):([^\s\"']+)")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
BODY = re.compile(r"(?:\s|\\[nr]|[\"'`+,]|[A-Za-z-]+: [^\n]*\n)*[A-Za-z0-9+/=]{16,}")
#: The base64 lines of a key, and a last short one.
RUN = re.compile(r"(?:(?:\s|\\[nr]|[\"'`+,]|[A-Za-z-]+: [^\n]*\n)*[A-Za-z0-9+/=]{16,}(?=[ \t]*(?:\r?\n|\\|[\"'`]|-----|\Z)))*")
TAIL = re.compile(r"(?:\s|\\[nr])*(?:[A-Za-z0-9+/]{0,15}={1,2}[A-Za-z0-9+/]{0,4}|[A-Za-z0-9+/]{1,15}(?=(?:\\[nr])*[\"'`]|\s*\Z))|[\"'`][+,\s]*[\"'`][A-Za-z0-9+/=]{1,15}(?=(?:\\[nr])*[\"'`])")
PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
CALL = re.compile(r"\b(?:log_?[iI]n|[lL]ogin|authenticate|basic_?[aA]uth|set_?[cC]redentials?)(?=\()")
COMMENT = re.compile(r"(?:^\s*(?:#|//|/?\*|--|;)|\s(?:#|//)\s)(.*)$")
COMMENTED = re.compile(r"[^\s,;\"'`<>()]{8,}")
#: What follows a literal that is a key; what precedes one that has a prefix; words that do not name what follows.
KEYED = re.compile(r"\s*[:\]]|\s*=>")
SUBSCRIPT = re.compile(r"[\w)\]\"'`?.]\[$")
MASKED = re.compile(r"(?=.*xxxx)(?:[x\W_]|\\.)+$", re.S)
PREFIX = re.compile(r"(?<!\w)[bBrRuUfF]{1,2}$")
JOINERS = frozenset(("or", "and", "if", "else", "not", "in"))
SAID = re.compile(r"(?i)\b(?:password|passwd|pwd|passphrase|secret|token|api[ _-]?key|credentials?|kennwort|passwort|contraseña|mot de passe|login)\b")
PLACEHOLDER = re.compile(
    r"(?i)^(?:<.*>|\$\{?.*|\{\{.*|%\(?\w+\)?s?%?|\*+|[x*.#+/=_-]+|\W*|.*(?:change|replace|set|fill)[_ -]?(?:it|me|this).*|(?:insert|your|my|put|enter|add)[_ -].*|.*(?:placeholder|example|dummy|sample|redacted|todo|fixme|not[_-]?set).*"
    r"|vault[:/].*|env[:/].*|secret[:/].*|aws-?ssm.*|arn:.*|ref\+.*|none|null|nil|true|false|undefined|test|.*-here)$"
)
UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
PART = re.compile(r"^(?:[A-Za-z]*\d{0,3}|v?\d+|\d{1,3}[a-z]{1,2})$")
#: Capitals strewn as no words have them.
ODD = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")
FOLDERS = re.compile(r"^\.{0,2}/[a-z0-9_.-]+(?:/[a-z0-9_.-]+)*/?$")
LAYERED = re.compile(r"^(?:[A-Za-z0-9+/_-]{24,}={0,2}|(?:%[0-9A-Fa-f]{2}|[\w.~-]){12,}|(?:\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|[\x20-\x7e])*\\[xu][0-9A-Fa-f]{2}.*)$", re.S)


def spoken(name: str) -> str:
    return " ".join(w.lower() for w in WORDS.findall(name))


def names_credential(name: str, beside: str = "") -> bool:
    """Whether a name is that of a credential: it says so, and not of its label, id, digest or the like.

    Other words may stand anywhere in it; the last credential that it speaks of counts. A name that speaks of a digest
    too is that of one if what is beside it has the form of one.
    """
    said = spoken(name)
    if DIGESTS & set(said.split()) and DIGEST.search(beside) and not DECODED.search(beside):
        return False
    last = None
    for last in PHRASES.finditer(said):
        pass
    if not last:
        return False
    before, after = said[: last.start()].split(), said[last.end() :].split()
    return not (after and after[0] in OTHER or before and before[-1] in BEFORE)


def secretlike(v: str) -> bool:
    """Whether a value can be a credential: no placeholder, reference, id, path, number or plain words."""
    if len(v) < 7 or PLACEHOLDER.match(v) or UUID.match(v) or any(c.isspace() for c in v):
        return False
    if "${" in v or "{{" in v or FOLDERS.match(v) or v.startswith(("http://", "https://", "sha256-", "sha512-", "sha384-", "ssh-")) or "%s" in v or "%d" in v:
        return False
    if not any(c.isalpha() for c in v) and len(v) < 12:
        return False
    odd = bool(len(v) >= 10 and ODD.search(v)) and not all(len(w) > 2 for w in WORDS.findall(v) if w.isalpha())
    mixed = any(c.isdigit() for c in v) or (v.lower() != v and v.upper() != v and any(not c.isalnum() for c in v))
    if not mixed and not odd:
        return False
    if not odd and all(PART.match(x) for x in re.split(r"[_./:,;=()\[\]{}<>|\s-]+", v)):
        return False
    return len(set(v)) >= 5


def openssh_key(data: bytes) -> bool:
    """Whether bytes are an OpenSSH private key: cipher, derivation and its options, the number of keys, as many public
    keys, and the private part, each with its length before it."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes:
        nonlocal at
        n = int.from_bytes(data[at : at + 4])
        if at + 4 + n > len(data):
            raise ValueError
        at += 4 + n
        return data[at - n : at]

    try:
        cipher, derived = field(), field()
        field()
        keys = int.from_bytes(data[at : at + 4])
        at += 4
        if not cipher or not derived or not 1 <= keys <= 64:
            return False
        return all([field() for _ in range(keys)]) and len(field()) >= 16
    except ValueError:
        return False


def der_key(data: bytes) -> bool:
    """Whether bytes are a private key container: PKCS#1, SEC 1, PKCS#8 (plain or encrypted), or OpenSSH's."""
    if data.startswith(b"openssh-key-v1\0"):
        return openssh_key(data)

    def head(at: int) -> tuple[int, int, int]:
        tag, n = data[at], data[at + 1]
        if n < 0x80:
            return tag, at + 2, at + 2 + n
        k = n & 0x7F
        if not 1 <= k <= 4:
            raise ValueError
        return tag, at + 2 + k, at + 2 + k + int.from_bytes(data[at + 2 : at + 2 + k])

    try:
        tag, at, end = head(0)
        if tag != 0x30 or end > len(data) or end < len(data) - 8 or end < 32:
            return False
        tag, a, b = head(at)
        if tag == 0x30:  # EncryptedPrivateKeyInfo
            t, _, e = head(b)
            return t == 0x04 and e == end and data[a] == 0x06
        if tag != 0x02 or b - a != 1 or data[a] > 1:
            return False
        t, c, d = head(b)
        if t == 0x30:
            u, _, e = head(d)
            return data[c] == 0x06 and u == 0x04 and e <= end
        if t == 0x02:
            return d - c >= 32
        return t == 0x04 and d - c >= 16
    except (IndexError, ValueError):
        return False


def layers(v: str) -> Iterator[bytes]:
    """What a literal decodes to, by each coding that it fits."""
    if re.fullmatch(r"(?:[0-9A-Fa-f]{2}){12,}", v):
        yield bytes.fromhex(v)
    if re.fullmatch(r"[A-Za-z0-9+/_-]{20,}={0,2}", v) and len(v.rstrip("=")) % 4 != 1:
        try:
            yield base64.b64decode(v.replace("-", "+").replace("_", "/").rstrip("=") + "=" * (-len(v.rstrip("=")) % 4))
        except (binascii.Error, ValueError):
            pass
    if v.count("%") * 6 > len(v) and re.search(r"%[0-9A-Fa-f]{2}", v):
        yield unquote(v).encode("utf-8", "replace")
    if re.search(r"\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}", v):
        yield re.sub(r"\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m.group(1) or m.group(2), 16)), v).encode("utf-8", "replace")


def hidden(v: str) -> bool:
    """Whether a literal decodes to a credential, through any number of layers: each is shorter than the one around it."""
    if len(v) < 16:
        return False
    for data in layers(v):
        if len(data) >= len(v.encode("utf-8", "replace")):
            continue
        if der_key(data):
            return True
        try:
            inner = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if inner == v or sum(c.isprintable() or c in "\r\n\t" for c in inner) < len(inner):
            continue
        if credentials(inner) or hidden(inner.strip()):
            return True
    return False


def credentials(text: str) -> list[tuple[int, int]]:
    """(start, end) offsets of the credentials of a text, in order and without overlaps."""
    if text.startswith("\ufeff"):
        text = " " + text[1:]
    found: list[tuple[int, int]] = []
    for m in PEM.finditer(text):
        body = BODY.match(text, m.end())
        if body and len(set(body.group(0)[-16:])) > 3:  # not one that is masked
            found.append((m.start(), key_end(text, m.end())))
    if STARTS.search(text):
        found += [m.span() for m in PROVIDER.finditer(text)]
    if "://" in text:
        for m in LOGIN.finditer(text):
            if not PLACEHOLDER.match(m.group(2)) and "${" not in m.group(2) and "{" not in m.group(2)[:1]:
                found.append(m.span(2))
    last = -1
    for m in HOT.finditer(text):
        a = text.rfind("\n", 0, m.start()) + 1
        if a <= last:
            continue
        b = text.find("\n", m.start())
        b = len(text) if b < 0 else b
        last = a
        found += line(text, a, b)
    for m in STRING.finditer(text):
        k = next((k for k in range(2, 6) if m.group(k) is not None), 2)
        v = m.group(k)
        if len(v) >= 20 and LAYERED.match(v) and hidden(v):
            found.append(m.span(k))
    for raw in re.finditer(r"^\s*(?:[\w.-]+\s*[:=]\s*)?([A-Za-z0-9+/]{40,}={0,2})\s*$", text, re.M):
        if hidden(raw.group(1)):
            found.append(raw.span(1))
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(found), key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
        elif e > out[-1][1]:
            out[-1] = (out[-1][0], e)
    return out


def key_end(text: str, at: int) -> int:
    """Where the private key ends whose BEGIN marker ends at ``at``: after its END marker, or else after its base64 body."""
    body = RUN.match(text, at).end()
    e = PEM_END.search(text, at)
    other = PEM.search(text, at)
    if e and not (other and other.start() < e.start()) and (e.start() - at < 20_000 or not text[body : e.start()].strip("\\nr\"'`+, \t\r\n")):
        return e.end()
    tail = TAIL.match(text, body)
    return tail.end() if tail else body


def joined(text: str, at: int, end: int) -> tuple[str, int]:
    """The literals that follow a literal ending at ``at`` across line ends and plus signs, and where they end."""
    more, stop = "", at
    while True:
        m = re.compile(r"[ \t]*(?:\+[ \t]*)?(?:\\?\r?\n[ \t]*(?:\+[ \t]*)?|(?<=\+[ \t])|(?<=\+))(?=[\"'`])").match(text, stop)
        if not m:
            return more, stop
        q = QUOTED.match(text, m.end())
        if not q:
            return more, stop
        more += q.group(1) or q.group(2) or q.group(3) or ""
        stop = q.end()


def named(text: str, a: int, b: int, s: str, strings: list[re.Match[str]], env: set[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """The literals of a line s = text[a:b] that stand by a credential's name of their own: one between them and the
    literal before. Where nothing is named in between, as in lists, what goes for the literal before goes for the next.
    Also where in s such literals start, be they masked already."""
    out: list[tuple[int, int]] = []
    places: list[int] = []
    last, state = 0, False
    for q in strings:
        if q.start() in env:
            last, state = q.end(), True
            continue
        i = q.start()
        while i and s[i - 1].isspace():
            i -= 1
        after = KEYED.match(s, q.end())
        if after and (SUBSCRIPT.match(s, max(0, i - 2), i) if after.group(0)[-1] == "]" else s[i - 1 : i] not in ("=", ":", "(", "|", "?")):
            continue  # a key, which names the next
        between = PREFIX.sub("", s[last : q.start()])
        names = [n for n in NAME.findall(between) if n not in JOINERS]
        if names:
            keys = [n for n in names if names_credential(n, s)] + CALL.findall(between)
            state = len(keys) > sum(bool(PHRASES.search(spoken(n))) and not names_credential(n, s) for n in names)
        last = q.end()
        if state:
            v = q.group(1) or q.group(2) or q.group(3) or ""
            more, stop = joined(text, a + q.end(), b)
            if secretlike(v + more) and not PHRASES.search(spoken(v)) or PROVIDER.search(v + more):
                out.append((a + q.start() + 1, (stop if more else a + q.end()) - 1))
                places.append(q.start())
            elif MASKED.match(v):
                places.append(q.start())
    return out, places


def statements(s: str, strings: list[re.Match[str]]) -> list[int]:
    """Where the statements of a line end, each after its semicolon, the last with the line."""
    ends, at = [], 0
    for q in [*strings, None]:
        until = q.start() if q else len(s)
        k = s.find(";", at, until)
        while k >= 0:
            ends.append(k + 1)
            k = s.find(";", k + 1, until)
        at = q.end() if q else until
    return ends if ends and ends[-1] == len(s) else [*ends, len(s)]


def beside(text: str, a: int, b: int, s: str, plain: str, strings: list[re.Match[str]], env: list[re.Match[str]], places: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The first literal of each statement that can be a credential where the statement names one, but no literal of it
    stands by such a name of its own (``places``)."""
    out: list[tuple[int, int]] = []
    envs = {q.start() for q in env}
    u = i = j = 0
    for v in ends:
        some, own = [], False
        while i < len(strings) and strings[i].start() < v:
            some.append(strings[i])
            i += 1
        while j < len(places) and places[j] < v:
            own, j = True, j + 1
        part, named_env = plain[u:v], any(q.start() in envs for q in some)
        u = v
        if own or not some:
            continue
        names = [n for n in NAME.findall(part) if PHRASES.search(spoken(n))]
        keys = [n for n in names if names_credential(n, s)]
        off = len(names) - len(keys)
        keys += CALL.findall(part)
        if not (keys or named_env) or off and not named_env and off >= len(keys):
            continue
        for q in some:
            w = q.group(1) if q.group(1) is not None else q.group(2) if q.group(2) is not None else q.group(3) or ""
            k = q.start()
            while k and s[k - 1].isspace():
                k -= 1
            if q.start() in envs or KEYED.match(s, q.end()) and s[k - 1 : k] not in ("=", ":", "(", "|", "?"):
                continue
            more, stop = joined(text, a + q.end(), b)
            if secretlike(w + more) and not PHRASES.search(spoken(w)) or PROVIDER.search(w + more):
                out.append((a + q.start() + 1, (stop if more else a + q.end()) - 1))
                break
    return out


def line(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Credentials that start on the line text[a:b], or on the next if it only opens a literal."""
    s = text[a:b].rstrip("\r")
    out: list[tuple[int, int]] = []
    for m in HEADER.finditer(s):
        v = m.group(2)
        if m.group(1) == "Basic":
            try:
                plain = base64.b64decode(v + "=" * (-len(v) % 4)).decode()
            except (binascii.Error, ValueError):
                continue
            user, colon, word = plain.partition(":")
            if colon and word and not PLACEHOLDER.match(word):
                out.append((a + m.start(2), a + m.end(2)))
        elif secretlike(v):
            out.append((a + m.start(2), a + m.end(2)))
    if "-u" in s:
        for m in CURL.finditer(s):
            if not PLACEHOLDER.match(m.group(2)) and "$" not in m.group(2):
                out.append((a + m.start(2), a + m.end(2)))
    strings = list(QUOTED.finditer(s))
    parts, at = [], 0
    for q in strings:
        if len(q.group(0)) > 2 and (q.end() >= len(s) or not KEYED.match(s, q.end())):
            parts += [s[at : q.start()], " " * (q.end() - q.start())]
            at = q.end()
    plain = "".join([*parts, s[at:]])
    keys = [n for n in NAME.findall(plain) if names_credential(n, s)]
    keys += CALL.findall(plain)
    env = [q for q in strings if re.fullmatch(r"[A-Z][A-Z0-9_]{2,}", q.group(1) or q.group(2) or "") and names_credential(q.group(0))]
    off = [n for n in NAME.findall(plain) if PHRASES.search(spoken(n)) and not names_credential(n, s)]
    own, places = named(text, a, b, s, strings, {q.start() for q in env})
    ends = statements(s, strings)
    out += own + beside(text, a, b, s, plain, strings, env, places, ends)
    m = BARE.match(s)
    if m and names_credential(m.group(1), s) and secretlike(m.group(2).rstrip(",;")) and not re.search(r"[(\[]", m.group(2)):
        out.append((a + m.start(2), a + m.start(2) + len(m.group(2).rstrip(",;"))))
    # "name: X_TOKEN" with the value on the next line, and a literal that only starts on the next line
    m = re.match(r"\s*(?:-\s*)?[\"']?(?:name|key)[\"']?\s*:\s*[\"']?([A-Za-z_][\w.-]*)[\"']?\s*,?\s*$", s)
    if m and names_credential(m.group(1)):
        n = re.compile(r"\r?\n\s*[\"']?value[\"']?\s*:\s*([\"']?)([^\s\"']+)\1").match(text, b - (text[b - 1 : b] == "\r"))
        if n and secretlike(n.group(2)):
            out.append(n.span(2))
    if keys and not off and re.search(r"(?:[=:]\s*\(?|\(|\+|\\)\s*$", s):
        n = re.compile(r"\r?\n[ \t]*(?=[\"'])").match(text, b - (text[b - 1 : b] == "\r"))
        q = QUOTED.match(text, n.end()) if n else None
        if q:
            v = q.group(1) or q.group(2) or ""
            more, stop = joined(text, q.end(), len(text))
            if secretlike(v + more):
                out.append((q.start() + 1, (stop if more else q.end()) - 1))
    c = COMMENT.search(s)
    if c:
        said = [t.end() for t in SAID.finditer(c.group(1))]
        base, told = a + c.start(1), False
        for t, until in zip(said, [*said[1:], len(c.group(1))], strict=False):
            for w in COMMENTED.finditer(c.group(1), t):
                if w.start() >= until:
                    break
                v = w.group(0).rstrip(".:")
                if secretlike(v) and len(v) >= 9 and "=" not in v[1:-2]:
                    out.append((base + w.start(), base + w.start() + len(v)))
                    told = True
                    break
                if MASKED.match(v):
                    told = True
        if said and not told:
            before = [q for q in strings if q.end() <= c.start(1)]
            start = max((e for e in ends if before and e <= before[-1].start()), default=0)
            for q in before:  # of the last statement before the comment
                v = q.group(1) or q.group(2) or ""
                if q.start() >= start and secretlike(v):
                    out.append((a + q.start() + 1, a + q.end() - 1))
    return out


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with letters and digits of the spans replaced by x; markers of private keys keep their words."""
    out, at = [], 0
    for s, e in spans:
        hid = re.sub(r"\\[nrtxu\\\"'`]|-----[A-Z0-9 ]+-----|[^\W_]", lambda m: m.group(0) if len(m.group(0)) > 1 else "x", text[s:e])
        out += [text[at:s], hid]
        at = e
    return "".join([*out, text[at:]])


def found_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no) of each line on which a credential starts, once per line; lines are 1-based, ended by \\n.

    NULL and empty bytes give no rows; bytes that are not UTF-8 stand for themselves.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos = [], []
            for f, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = data.decode("utf-8", "surrogateescape")
                rows = sorted({text.count("\n", 0, s) + 1 for s, _ in credentials(text)})
                ids += [f] * len(rows)
                nos += rows
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(nos, type=pa.int32())], names=["file_id", "line_no"])

    return files.where("source_bytes is not null").select("file_id", "source_bytes").mapInArrow(scan, "file_id long, line_no int")


def redacted(files: DataFrame) -> DataFrame:
    """(file_id, relpath, masked, text, source_bytes) for the files with credentials: how many were masked, the masked
    text, and its bytes, which outside of credentials are those of the file even where these are not UTF-8."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for f, path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = data.decode("utf-8", "surrogateescape")
                spans = credentials(text)
                if spans:
                    out = mask(text, spans).encode("utf-8", "surrogateescape")
                    rows.append((f, path, len(spans), out.decode("utf-8", "replace"), out))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["file_id", "relpath", "masked", "text", "source_bytes"])

    return files.where("source_bytes is not null").select("file_id", "relpath", "source_bytes").mapInArrow(scan, "file_id long, relpath string, masked int, text string, source_bytes binary")
