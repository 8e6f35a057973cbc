"""A small table of labelled urls, by rule from words that were labelled by hand."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

#: Words of hosts and paths that are to be blocked: gambling, medicine by post, pornography, advertising and its
#: networks, linkfarms, pirated software, feigned logins and prizes, usury.
BLOCKED = """
casino poker roulette jackpot slots blackjack bets betting sportsbet gamble gambling lotto bingo spins wager bookmaker
pills viagra cialis pharma meds rx tramadol steroids painkillers dieting slimming
porn porno xxx sex sexy adult erotic escort nude webcams hentai milf fetish hookup
ads adserver adclick banner popup tracker track tracking affiliate clickbait doubleclick pixel sponsor
spam linkfarm backlinks seoboost spamfarm doorway spinner autoblog splog
warez crack keygen torrent nulled serial pirated cracked hacks cheats
phishing malware verifylogin freegift winner winners win freeprize giveaway freemoney bitcoinprofit getrich
payday quickloan cashadvance cheap replica discountrolex fakeid essaymill
""".split()

#: Words that are not, among them such as hold a blocked one.
ALLOWED = """
news blog wiki docs library museum school university college science history garden kitchen recipes travel weather
music theatre concert football tennis cycling hiking camera books reading poetry novel journal research physics
chemistry biology maths software python database network linux forum support help about contact archive city council
hospital clinic doctor nurse charity church family children parents teacher student homework language grammar
essex sussex middlesex sextant therapist specialist socialist dickens cocktail peacock analysis address roads heads
beads loads uploads threads winter window twins winery swing freedom freelance carefree farm farmers farmhouse pillow
pillar caterpillar alphabet better betsy between racetrack soundtrack tractor cassini crackers nutcracker torrential
hackney hackathon loanword prizewinning gifted adulthood cheapside trackless banners popular serialise pixels
adaptation adrian admiral additive shadows readiness bingley spinning pharmacology medsoc sponge
""".split()

#: Parts of invented names, as any language has them: what is unknown is harmless.
SYLLABLES = "th er on an in re at or ti st ha en ou nd sh ing tion ble ka lo mi ve du pa su ro ne la to be".split()
FRONTS = ("", "", "www.", "www.", "m.", "blog.", "shop.", "static.", "cdn.")
ENDS = (".com", ".net", ".org", ".info", ".io", ".de", ".fr", ".co.uk", ".example.com", ".example.net", ".example.org")
PATHS = ("", "/", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}", "/index.php", "/{y}/05/story-{n}.html", "/p/{n}", "/a/b/{n}", "/view/{n}.htm")


def _pick(choices, *key):
    return choices[zlib.crc32(repr(key).encode()) % len(choices)]


def _names(words: list[str], i: int, blocked: bool) -> Iterator[str]:
    word = words[i]
    other = _pick(words, word, "other")
    plain = _pick(ALLOWED, word, "plain")
    invented = "".join(_pick(SYLLABLES, word, k) for k in range(3))
    yield word
    yield f"{word}-{other}"
    yield f"{other}{word}" if i % 2 else f"{word}{other}"
    yield f"{word}-{_pick('xzqk', word)}" if blocked else f"{word}-{i % 10}"
    yield f"{word}{i}"
    yield f"{word}-{invented}"
    yield f"{plain}-{word}"
    yield f"{word}-{_pick(ALLOWED, word, 'behind')}"


def labelled_urls() -> list[tuple[str, bool]]:
    """(url, blocked): each word in hosts and in paths, both kinds within the same surroundings; and invented hosts, not blocked."""
    out = []

    def add(name: str, path: str, blocked: bool) -> None:
        n = zlib.crc32(name.encode()) % 1000
        scheme = _pick(("http", "https"), name, path)
        host = _pick(FRONTS, name, path, "front") + name + _pick(ENDS, name, path, "end")
        out.append((f"{scheme}://{host}{path.format(n=n, y=2000 + n % 25)}", blocked))

    for words, blocked in ((BLOCKED, True), (ALLOWED, False)):
        for i, word in enumerate(words):
            for k, name in enumerate(_names(words, i, blocked)):
                add(name, _pick(PATHS, name, k), blocked)
            invented = "".join(_pick(SYLLABLES, word, "host", k) for k in range(2 + i % 3))
            for form in ("/{w}/{{n}}", "/{{n}}/{w}-{o}.html", "/{p}-{w}/{{n}}", "/{p}-{w}-online.html"):
                host = _pick((invented, _pick(ALLOWED, word, form, "host")), word, form, "which")
                add(host, form.format(w=word, o=_pick(words, word, form), p=_pick(ALLOWED, word, form)), blocked)
    for i in range(1500):
        add("".join(_pick(SYLLABLES, i, k) for k in range(2 + i % 4)), _pick(PATHS, i), False)
    return out
