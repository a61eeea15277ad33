"""Made-up secrets and things that only look like them, set into passages of the corpus as labelled examples for the tagger."""

from __future__ import annotations

import base64
import random
import string
from collections.abc import Callable

LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
BASE62 = LOWER + UPPER + DIGITS
URL64 = BASE62 + "-_"
# Parts of made-up passwords and names (fixed values)
STEMS = "dragon summer winter monkey shadow silver tiger garden rocket copper falcon magic orange purple castle river hunter sword fish trout coffee planet music horse battery staple".split()
NAMES = "admin root user deploy service backup anna build ci reporting".split()
HOSTS = "db.internal redis01 mq.example.net 10.0.4.7 cache-2 localhost pg.example.com".split()
#: {} is where the secret goes. The first group is for passwords, the second for tokens.
SAID = [
    "password is {}", "the password is {}", "Password: {}", "pwd {}", "pass {}", "passphrase is {}", "my passwd is {} please", "login admin / {}", "passcode {}", "credentials: admin {}",
    "use the password {} to log in", "Passwort: {}", "das Passwort ist {}", "Kennwort {}", "la contraseña es {}", "clave: {}", "le mot de passe est {}", "mdp : {}", "root password was {}", "pwd={}",
    "DB_PASSWORD {}", "my secret is {}", "secret: {}", "private key {}", "PIN {}",
]
HELD = [
    "Authorization: Bearer {}", "Bearer {}", "api key {}", "the key is {}", "X-Api-Key: {}", "token {}", "access token is {}", "auth token: {}", "export API_TOKEN {}", "API_SECRET_KEY -> {}",
    "client secret {}", "key {}", "use {} as the api key", "the token {} is for staging", "credentials {}", "{}", "see {}", "set to {} for now", "secret {}",
]


def _of(dice: random.Random, letters: str, least: int, most: int | None = None) -> str:
    return "".join(dice.choice(letters) for _ in range(dice.randint(least, most or least)))


def _password(dice: random.Random) -> str:
    a, b = dice.choice(STEMS), dice.choice(STEMS)
    return dice.choice(
        [
            lambda: a.title() + b.title(), lambda: a + _of(dice, DIGITS, 1, 4), lambda: a.title() + _of(dice, DIGITS, 2, 4) + dice.choice("!#$%&*"), lambda: _of(dice, BASE62, 8, 16),
            lambda: _of(dice, LOWER + UPPER, 10, 18), lambda: "-".join([a, b, dice.choice(STEMS)]), lambda: a[0].upper() + "0" + a[2:] + _of(dice, DIGITS, 2), lambda: _of(dice, LOWER, 9, 14),
            lambda: _of(dice, LOWER + DIGITS, 7, 12), lambda: a.title() + b.title() + _of(dice, DIGITS, 1, 3),
        ]
    )()


def _pem(dice: random.Random) -> tuple[str, str]:
    lines = [base64.b64encode(dice.randbytes(48)).decode() for _ in range(dice.randint(2, 6))]
    kind = dice.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"])
    return f"-----BEGIN {kind}-----\n{{}}\n-----END {kind}-----", "\n".join(lines)


def _url(dice: random.Random) -> tuple[str, str]:
    scheme = dice.choice(["postgres", "mysql", "redis", "amqp", "mongodb", "https", "ftp"])
    return f"{scheme}://{dice.choice(NAMES)}:{{}}@{dice.choice(HOSTS)}/{dice.choice(STEMS)}", dice.choice([_of(dice, BASE62, 8, 20), dice.choice(STEMS) + _of(dice, DIGITS, 2, 4)])


def _held(make: Callable[[random.Random], str]) -> Callable[[random.Random], tuple[str, str]]:
    return lambda dice: (dice.choice(HELD), make(dice))


#: By kind: what stands around a secret, and the secret.
SECRETS: dict[str, Callable[[random.Random], tuple[str, str]]] = {
    "password": lambda d: (d.choice(SAID), _password(d)),
    "code host token": _held(lambda d: d.choice(["ghp_", "gho_", "ghs_"]) + _of(d, BASE62, 36)),
    "payment key": _held(lambda d: d.choice(["sk_live_", "rk_live_", "sk_test_"]) + _of(d, BASE62, 24)),
    "chat token": _held(lambda d: f"{d.choice(['xoxb', 'xoxp'])}-{_of(d, DIGITS, 11)}-{_of(d, DIGITS, 11)}-{_of(d, BASE62, 24)}"),
    "random token": _held(lambda d: _of(d, d.choice([BASE62, URL64, LOWER + DIGITS, UPPER + DIGITS]), 20, 44)),
    "letters only": lambda d: (d.choice([x for x in HELD if len(x) > 8]), _of(d, LOWER + UPPER, 16, 32)),
    "web token": _held(lambda d: "eyJ" + _of(d, BASE62, 20, 30) + ".eyJ" + _of(d, BASE62, 30, 60) + "." + _of(d, URL64, 43)),
    "base64": _held(lambda d: base64.b64encode(d.randbytes(d.choice([20, 24, 32, 40, 48]))).decode()),
    "address with password": _url,
    "private key": _pem,
    # those below are held out where recall on unseen kinds is measured
    "package token": _held(lambda d: d.choice(["npm_", "pypi-"]) + _of(d, BASE62, 36)),
    "cloud key": _held(lambda d: "AIza" + _of(d, URL64, 35)),
    "repository token": _held(lambda d: "glpat-" + _of(d, URL64, 20)),
    "mail key": _held(lambda d: f"SG.{_of(d, URL64, 22)}.{_of(d, URL64, 43)}"),
    "model token": _held(lambda d: "hf_" + _of(d, LOWER + UPPER, 34)),
    "basic": lambda d: ("Authorization: Basic {}", base64.b64encode(f"{d.choice(NAMES)}:{_password(d)}".encode()).decode()),
}
#: Kinds that a test of held-out kinds leaves out.
UNSEEN = ("package token", "cloud key", "repository token", "mail key", "model token", "basic")


def _decoy(dice: random.Random) -> str:
    word, other = dice.choice(STEMS), dice.choice(STEMS)
    return dice.choice(
        [
            lambda: f"{word}.{other}{dice.randint(1, 99)}@mail{dice.randint(1, 9)}.example.com", lambda: f"https://www.{word}{other}.com/{other}/{dice.randint(1, 9999)}?page={dice.randint(1, 9)}",
            lambda: f"+1 ({dice.randint(200, 999)}) 555-{dice.randint(1000, 9999)}", lambda: ".".join(str(dice.randint(0, 255)) for _ in range(4)), lambda: f"{dice.randint(1990, 2030)}-{dice.randint(1, 12):02}-{dice.randint(1, 28):02}",
            lambda: f"v{dice.randint(0, 9)}.{dice.randint(0, 30)}.{dice.randint(0, 30)}", lambda: f"INV-{dice.randint(2015, 2030)}-{dice.randint(0, 99999):05}", lambda: f"{word.title()}{other.title()}{dice.choice(['Manager', 'Test', 'Error', ''])}",
            lambda: f"{word}_{other}_{dice.choice(['count', 'id', 'name'])}", lambda: f"src/{word}/{other}/{dice.choice(STEMS)}.py", lambda: f"#{word}{dice.randint(1, 2030)}", lambda: f"ISBN 978-{dice.randint(0, 9)}-{dice.randint(100, 999)}-{dice.randint(10000, 99999)}-{dice.randint(0, 9)}",
            lambda: f"{dice.randint(1, 999)},{dice.randint(0, 999):03},{dice.randint(0, 999):03}", lambda: f"{word}{dice.randint(1, 30)}", lambda: f"{dice.randint(1, 30)}{dice.choice(['km', 'kg', 'GB', 'px', 'th'])}",
            lambda: f"the {dice.choice(['password', 'token', 'key', 'secret', 'pin'])} {dice.choice(['was lost', 'must be long', 'of the house', 'to success is work', 'is not shown here', 'that we sent you'])}",
            lambda: f"{dice.choice(['forgot your password?', 'change the password soon', 'a secret place', 'a bearer of news', 'key idea here', 'basic rules apply'])}",
            lambda: f"def {word}_{other}(self, {word}): return {other}.{word}[{dice.randint(0, 9)}]", lambda: f"{word.upper()}_{other.upper()} = {dice.randint(1, 999)};", lambda: f"{word}-{other}-{dice.choice(STEMS)}",
            lambda: f"{_of(dice, UPPER, 2)}{_of(dice, DIGITS, 2)} {_of(dice, DIGITS, 4)}", lambda: f"{word.upper()}{other.upper()}!!", lambda: f"{word}***",
        ]
    )()


def example(passage: str, dice: random.Random, kinds: tuple[str, ...], secrets: int = 1, decoys: int = 2) -> tuple[str, list[tuple[int, int]], list[str]]:
    """The passage with some decoys and secrets put between its words; the secrets' spans, and their kinds."""
    words = passage.split(" ")
    parts: list[tuple[str, str | None, str]] = [(_decoy(dice), None, "") for _ in range(decoys)]
    for _ in range(secrets):
        kind = dice.choice(kinds)
        around, secret = SECRETS[kind](dice)
        parts.append((around, secret, kind))
    places = sorted((dice.randint(0, len(words)), i) for i in range(len(parts)))
    out, spans, found, last = "", [], [], 0
    for place, i in places:
        out += "".join(w + " " for w in words[last:place])
        last = place
        around, secret, kind = parts[i]
        if secret is None:
            out += around
        else:
            head, _, tail = around.partition("{}")
            quote = dice.choice(["", "", "", '"', "'", "`"]) if kind not in ("private key", "address with password") else ""
            out += head + quote
            start = len(out)
            for line in secret.split("\n"):
                at = start + secret.index(line)
                spans.append((at, at + len(line)))
                found.append(kind)
            out += secret + quote + tail
        out += dice.choice([" ", " ", " ", ". ", "\n", ", "])
    return out + " ".join(words[last:]), spans, found
