"""The small labelled table that the personal-data tagger learns from: sentences with marked stretches.

Patterns are sentences in which a name in braces stands for a stretch of that kind. Stretches are drawn by rule, names from
syllables, so that a tagger learns cues and word shapes and not a list of names."""

from __future__ import annotations

import random

#: Sentences with personal data. {person}, {street}, {birth} and {account} are marked; {city}, {number} and {word} are not.
PATTERNS = (
    "My name is {person}.", "my name is {person} and I work in {city}.", "Hello, my name is {person}, nice to meet you.", "I am called {person}, please write to me.",
    "Name: {person}", "Full name: {person}", "Customer name: {person}, phone below", "Patient: {person}", "Patient name: {person}; born {birth}", "Contact: {person}",
    "Contact person: {person}, {street}, {city}", "Dear Mr. {person}, thank you for the {word}.", "Dear Mrs. {person}, we have received the {word}.", "Please ask Dr. {person} about it.",
    "Mr {person} signed the {word}.", "Ms. {person} will be there.", "Signed by {person} on behalf of the owner.", "Best regards, {person}", "Kind regards,{person}", "Sincerely, {person}",
    "Employee: {person}, ID number {account}", "The account holder is {person}.", "written by Mr. {person}", "Regards, {person}",
    "I live at {street}, {city}.", "She lives at {street}.", "Address: {street}, {city}", "Home address: {street}", "Ship to: {street}, {city} {number}", "Our address is {street}, {city}.",
    "Billing address: {street}", "He moved to {street} last year.",
    "Date of birth: {birth}", "DOB: {birth}", "born on {birth} in {city}", "I was born on {birth}.", "Birthday: {birth}", "born {birth}", "date of birth {birth}",
    "SSN: {account}", "My SSN is {account}.", "Social security number: {account}", "Passport number: {account}", "passport no. {account}", "IBAN: {account}", "IBAN {account}",
    "Please pay to IBAN {account} today.", "Driver license number: {account}", "Account number: {account}", "ID number: {account}", "Tax ID: {account}",
    "Mein Name ist {person}.", "Ich heiße {person} und wohne in {city}.", "Sehr geehrter Herr {person}, vielen Dank.", "Sehr geehrte Frau {person}, vielen Dank.", "Herr {person} wohnt in {city}.",
    "Anschrift: {street}, {city}", "wohnhaft {street}", "geboren am {birth} in {city}", "Geburtsdatum: {birth}", "Kontonummer: {account}", "Mit freundlichen Grüßen, {person}",
    "Je m'appelle {person}.", "Nom: {person}", "Monsieur {person} habite ici.", "Madame {person} est venue.", "Adresse: {street}, {city}", "né le {birth}", "Date de naissance: {birth}",
    "Me llamo {person}.", "Mi nombre es {person}.", "Señor {person}, gracias por su carta.", "Señora {person}, gracias.", "Nombre: {person}", "Dirección: {street}", "Fecha de nacimiento: {birth}", "nacido el {birth}",
)
#: Sentences without any, many of them with the same cue words or shapes.
PLAIN = (
    "My name is on the list.", "The name is {word}.", "the name of the {word} is not known", "Name: none", "Name of the {word}", "I am called at night.", "{Word} {word} {word} {word}.", "{Word} {word} {Word} {word}, {word}.",
    "{Word} {Word} {word} the {word}.", "{WORD} {WORD} {WORD} {WORD}", "{WORD}!! {WORD}, {word} {number}", "{Word} {Word} {Word}.", "{Word}, {word} {number} {word}.", "In {number} the {word} was {word}.", "On {date} the {word} opened.",
    "Version {number}.{number} of the {word}", "See page {number} and page {number}.", "{Word}: {word} {word}", "{Word}: {Word} {Word}", "The address of the {word} is unknown.", "Address: see below", "Contact: see the {word} page",
    "Contact us for the {word}.", "Dear all, thank you for the {word}.", "Dear reader, {word} {word}.", "The patient {word} and the {word}.", "Kind regards", "Best regards and {word}", "born in {city}", "was born to {word}", "the date of {date}",
    "Date: {date}", "published on {date}", "Licensed under the {Word} License, Version {number}.", "Copyright {number} {Word} {Word}", "MIT License", "Apache License, Version 2.0", "GNU General Public License", "The {Word} Street {word} is closed.",
    "number {number}", "ID: {number}", "{number} {Word} {word}", "{number} {word} {word}, {number} {word}", "Account number is needed.", "passport number and {word}", "Please pay the {word} today.", "{Word} & {Word} {number}",
    "Mein {word} ist {word}.", "Der Name ist {word}.", "Ich heiße das gut.", "Herr der {word}", "die Frau und {word}", "{Word} {word} und {Word} {word}.", "Die {Word} {word} der {Word}.", "Das {Word} und die {Word} von {Word}.",
    "Je {word} la {word}.", "Le nom de la {word}.", "Madame et {word}", "la {word} de {Word} {word}", "El {word} y la {word}.", "La dirección de {word}", "el nombre de {word}", "señor y señora", "De {word}, {word} {Word} {word}.",
    "{Word}. {Word} {word} {word}. {Word} {word}", "{Word} {word}.{Word} {word} {word}!", "{word} {word} {word} {word} {word} {word}", "+1 ({three}) 555-{four} {word} {word}", "{word}.{number}@mail{number}.example.com {word}",
    "{three}.{three}.{number}.{number} {word}", "4{three}{four}{four}{four} {word}", "password = \"{word}{number}\"", "token: {word}{number}{word}", "# {Word} {word}", "* {Word} {word} {word}", "{Word} {word} ({number})",
)
CITIES = ("Berlin", "Madrid", "Paris", "London", "Springfield", "Hamburg", "Lyon", "Leeds")
STREETS = ("Street", "St", "St.", "Road", "Rd", "Avenue", "Ave", "Ave.", "Lane", "Drive", "Boulevard")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
REPEATS, PROSE = 10, 900


def _syllables(rng: random.Random, least: int = 2, most: int = 4) -> str:
    return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice(["a", "e", "i", "o", "u", "an", "er", "in", "on", "ü", "é"]) for _ in range(rng.randint(least, most)))


def _name(rng: random.Random) -> str:
    first, last = (_syllables(rng, 2, 3).capitalize() for _ in range(2))
    return rng.choice([f"{first} {last}", f"{first} {last}", f"{first} {rng.choice('ABCDEFGHJKLMRST')}. {last}", f"{first} {last}-{_syllables(rng).capitalize()}", last])


def _date(rng: random.Random) -> str:
    d, m, y = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1930, 2012)
    return rng.choice([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m:02}/{d:02}/{y}", f"{d} {MONTHS[m - 1]} {y}", f"{MONTHS[m - 1]} {d}, {y}"])


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _drawn(kind: str, rng: random.Random) -> str:
    if kind == "person":
        return _name(rng)
    if kind == "street":
        named = f"{_syllables(rng, 2).capitalize()} {rng.choice(STREETS)}"
        german = f"{_syllables(rng, 2).capitalize()}{rng.choice(['straße', 'weg', 'gasse'])} {rng.randint(1, 199)}"
        romance = f"{rng.choice(['calle', 'Calle', 'rue', 'Rue de'])} {_syllables(rng, 2).capitalize()} {rng.randint(1, 199)}"
        return rng.choice([f"{rng.randint(1, 9999)} {named}", f"{rng.randint(1, 999)} {named}", german, romance])
    if kind in ("birth", "date"):
        return _date(rng)
    if kind == "account":
        iban = rng.choice(["DE", "FR", "ES", "GB"]) + _digits(rng, 2) + rng.choice([" ", ""]).join(["", *[_digits(rng, 4) for _ in range(4)]])
        return rng.choice([f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}", iban, rng.choice("ABCXYZ") + _digits(rng, 8), _digits(rng, 9)])
    fixed = {"city": rng.choice(CITIES), "number": str(rng.randint(0, 300)), "three": _digits(rng, 3), "four": _digits(rng, 4)}
    word = _syllables(rng)
    return fixed.get(kind) or {"word": word, "Word": word.capitalize(), "WORD": word.upper()}[kind]


def _prose(rng: random.Random) -> str:
    """Sentences of made-up words, short and long, with capitals, lists, headings and numbers as texts have them."""
    short = lambda: rng.choice("aeiou") + rng.choice(["", "n", "r", "s", "t"]) if rng.random() < 0.3 else _syllables(rng)
    out = []
    for _ in range(rng.randint(1, 4)):
        style, words = rng.random(), [short() for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.2:  # one word again and again
            words = [rng.choice([words[0], words[0].capitalize()]) + rng.choice(["", "", "."])] * rng.randint(2, 25)
        words = [w.upper() for w in words] if style < 0.1 else [w.capitalize() if rng.random() < 0.3 else w for w in words] if style < 0.3 else words
        if rng.random() < 0.15:
            words.insert(rng.randint(0, len(words)), str(rng.randint(0, 10 ** rng.randint(1, 9))))
        words[0] = words[0][:1].upper() + words[0][1:]
        out.append(rng.choice([" ", " ", " ", ", "]).join(words) + rng.choice([".", ".", ".", "!", "?", ":", "", ". "]))
    return rng.choice([" ", " ", " ", "\n", ""]).join(out)


def sentences(repeats: int = REPEATS, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with their marked stretches (kind, start, end); every pattern is drawn ``repeats`` times; prose without any comes first."""
    rng = random.Random(seed)
    out: list[tuple[str, list]] = [(_prose(rng), []) for _ in range(PROSE)]
    for _ in range(repeats):
        for pattern in (*PATTERNS, *PLAIN):
            text, marks = "", []
            for part in pattern.replace("{", "\0{").replace("}", "}\0").split("\0"):
                if part.startswith("{"):
                    kind, start = part[1:-1], len(text)
                    text += _drawn(kind, rng)
                    if kind in ("person", "street", "birth", "account"):
                        marks.append((kind, start, len(text)))
                else:
                    text += part
            out.append((text, marks))
    return out
