"""Generated examples of personal data in other than the base forms, and of text that looks like it."""

from __future__ import annotations

import random

#: Sentences around personal data, by kind.
CARRIERS = {
    "email": ["you can reach me under {}", "send your application to {} by friday", "questions go to {} please", "my address is {} at work", "schreib mir an {} wenn du magst", "Anfragen bitte an {}", "contactez {} pour en savoir plus", "escríbeme a {} mañana", "reply to {}", "mail {}", "sign up with {} and a password", "the author ({}) answers quickly"],
    "ip": ["the server at {} does not answer", "requests came from {} all night", "block {} in the firewall", "der Rechner {} ist nicht erreichbar", "ping {} failed", "l'adresse {} est bloquée", "the host {} was scanned", "connect to {} on the usual port", "log entry: client {} refused", "el servidor {} no responde", "resolves to {}"],
    "card": ["paid with card {} yesterday", "my visa is {} and it expires soon", "charge {} for the stay", "die Karte {} wurde gesperrt", "numéro de carte {}", "la tarjeta {} fue robada", "card number: {}", "debit {} please", "mastercard {} declined"],
    "phone": ["call me on {} tonight", "her number is {}", "phone: {}", "ring {} for a table", "Telefon {} (abends)", "ruf {} an", "appelez le {} avant midi", "llame al {} por favor", "fax {}", "text {} to confirm", "our office, {}, is open daily", "mobile {}"],
}
#: Sentences that tell nothing about what is in them.
PLAIN = ["{}", "and then {} again", "it said {} there", "note {}", "siehe {} unten", "voir {}", "aquí {} otra vez", "see {} below", "the entry reads {}", "({})", "first {} and more text after it"]
#: Sentences around other numbers and names.
OTHER = ["on {} we met again", "released as {} last week", "chapter {} covers this", "the sum of {} was paid", "he was born {}", "lot {} arrived damaged", "a total of {} units", "pages {} are missing", "am {} in Bonn", "le {} à Paris", "el {} en Madrid", "part no {} is out of stock", "measured {} twice", "they won {} away", "the code calls {} first", "between {} and noon", "ratio {} in the table", "invoice {} is due", "isbn {}", "from {} on", "the figure {} shows it", "in {} the war ended"]


def examples(n: int, seed: int) -> list[tuple[str, str, int, int, bool]]:
    """n of (kind, text, start, end, good): the place of a span in a text, and whether it is personal data of the kind."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def digits(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def word(low: int = 2, high: int = 9) -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(low, high)))

    def luhn(body: str, good: bool) -> str:
        total = sum((int(c) * 2) % 10 + int(c) // 5 if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str((-total + (0 if good else r.randint(1, 9))) % 10)

    def grouped(text: str, sizes: list[int], sep: str) -> str:
        at, parts = 0, []
        for k in sizes:
            parts.append(text[at : at + k])
            at += k
        return sep.join(parts)

    def email() -> str:
        user = r.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word(1, 1)}_{word()}"])
        ends = r.choice([["com"], ["org"], ["de"], ["net"], ["co", "uk"], ["edu"], ["fr"], ["es"], ["io"]])
        form = r.random()
        if form < 0.25:
            return f"{user}{r.choice([' @ ', '@ ', ' @'])}{word(3)}{r.choice(['.', ' . '])}{'.'.join(ends)}"
        if form < 0.5:
            return f"{user} at {word(3)} dot {' dot '.join(ends)}"
        a, b = r.choice(["[]", "()", "{}", "<>"])
        gap = r.choice(["", " "])
        dots = r.choice([f"{gap}{a}dot{b}{gap}", "."]) if r.random() < 0.8 else r.choice(["[.]", "(.)"])
        return f"{user}{gap}{a}at{b}{gap}{dots.join([word(3), *ends])}"

    def address() -> str:
        form = r.random()
        if form < 0.45:
            return r.choice(["[.]", "(.)", "[dot]", "(dot)", "{.}"]).join(str(r.randint(0, 255)) for _ in range(4))
        if form < 0.55:
            return r.choice([" dot ", " . ", ". "]).join(str(r.randint(1, 255)) for _ in range(4))
        parts = [f"{r.randint(0, 65535):x}" for _ in range(8)]
        if form < 0.7:
            return ":".join(parts)
        a, b = r.randint(1, 4), r.randint(0, 3)
        return r.choice(["2001:db8", "fe80", "2a02", "fd00"]) + (":" + ":".join(parts[: a - 1]) if a > 1 else "") + "::" + ":".join(parts[a : a + b])

    def card(good: bool) -> str:
        sep = r.choice([".", "/", "_", " - ", "  "])
        if r.random() < 0.25:
            return grouped(luhn(r.choice(["34", "37"]) + digits(12), good), [4, 6, 5], r.choice([".", "/", "_", " - "]))
        return grouped(luhn(r.choice("3456") + digits(14), good), [4, 4, 4, 4], sep)

    def phone() -> str:
        return r.choice([
            lambda: f"({r.randint(200, 989)}) {r.randint(200, 989)}-{digits(4)}", lambda: f"{r.randint(200, 989)}-{r.randint(200, 989)}-{digits(4)}", lambda: f"{r.randint(200, 989)}.{r.randint(200, 989)}.{digits(4)}",
            lambda: f"0{r.randint(20, 999)} {digits(3)} {digits(4)}", lambda: f"0{r.randint(20, 9999)}/{digits(r.randint(5, 8))}", lambda: f"0{r.randint(1, 6)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", lambda: f"00{r.choice(['1', '33', '44', '49', '34'])} {r.randint(20, 999)} {digits(3)} {digits(4)}",
            lambda: f"0{r.randint(20, 999)}-{digits(r.randint(6, 8))}", lambda: f"{r.randint(200, 989)}-{digits(4)}",
        ])()

    def unlike(kind: str) -> str:
        day, month, year = r.randint(1, 28), r.randint(1, 12), r.randint(1900, 2030)
        if kind == "email":
            return r.choice([f"{word()} at {word()} dot {word()}", f"{word()} at home dot {digits(3)}", f"we meet at {word()} dot dot", f"{word()} @ {digits(2)} . {word()}", f"{word()} (at) {digits(1)} . {digits(2)}", f"{word()} [at] {word()} . {word()} then", f"price @ {digits(2)} . 50"])
        if kind == "ip":
            return r.choice([f"{word()}::{word()}", f"std::{word()}", f"{digits(2)}:{digits(2)}:{digits(2)}", ":".join(f"{r.randint(0, 255):02X}" for _ in range(6)), f"{digits(1)}. {digits(1)}. {digits(2)}. {digits(2)}", "::", "[.]".join(str(r.randint(256, 999)) for _ in range(4)), f"{word()}:: {digits(2)}", f"{digits(3)} . {digits(3)} . {r.randint(256, 999)} . {digits(3)}", "a::b", f"{r.randint(1, 9)}::{r.randint(1, 9)}"])
        if kind == "card":
            return r.choice([lambda: card(False), lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"{digits(4)} / {digits(4)}", lambda: f"{year}-{month:02}-{day:02} {digits(2)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"{digits(4)}_{digits(4)}_{digits(4)}_{digits(4)}", lambda: f"{digits(2)}.{digits(4)} {digits(2)}.{digits(4)}", lambda: f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"])()
        return r.choice([f"{day:02}.{month:02}.{year}", f"{day:02}/{month:02}/{year}", f"{year}-{month:02}-{day:02}", f"{year}-{year + 3}", f"({year}) {digits(2)} {digits(2)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(3)}-{digits(4)}-{digits(4)}", f"0{digits(1)}.{digits(2)}.{digits(2)}", f"{digits(3)}.{digits(2)}.{digits(3)}", f"{digits(3)}.{digits(4)}", f"{r.randint(100, 999)}-{r.randint(1000, 9999)}", f"00{digits(1)} {digits(2)} {digits(1)}"])

    out = []
    for _ in range(n):
        kind, good = r.choice(list(CARRIERS)), r.random() < 0.5
        span = {"email": email, "ip": address, "card": lambda: card(True), "phone": phone}[kind]() if good else unlike(kind)
        around = r.choice(PLAIN) if r.random() < 0.5 else r.choice(CARRIERS[kind] if r.random() < (0.8 if good else 0.25) else OTHER)
        before, after = around.split("{}")
        lead = r.choice(["", "", f"{word()} {word()}. ", f"{word()} "])
        text = lead + before + span + after + r.choice(["", ".", ", thanks", f" {word()}", "\n"])
        out.append((kind, text, len(lead) + len(before), len(lead) + len(before) + len(span), good))
    return out
