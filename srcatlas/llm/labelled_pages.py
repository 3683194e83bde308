"""Pages made by rule, with the label of each leaf block known from the part that it was made for.

They train the chain of `html_extraction` where no labelled pages are given.  Parts come in
telling markup (elements and class names), in misleading order, and in markup that says nothing,
where only the text tells what a block is.
"""

from __future__ import annotations

import random

#: How parts may be marked: elements, and class names or ids of a plain division.
MARKS = {
    "article": (("article", "main"), ("article", "main", "content", "post", "entry", "story", "page-body")),
    "menu": (("nav", "header", "menu"), ("nav", "menu", "navbar", "top-links", "breadcrumb", "toolbar")),
    "advert": (("aside",), ("ad", "ads", "advert", "promo", "sponsor", "banner")),
    "sidebar": (("aside",), ("sidebar", "related", "widget", "recommended", "social", "share")),
    "notice": (("dialog",), ("notice", "cookie", "consent", "popup", "modal", "login")),
    "form": (("form",), ("search", "subscribe", "newsletter", "signup")),
    "comments": (("section",), ("comments", "comment", "replies", "discussion")),
    "footer": (("footer",), ("footer", "copyright", "legal", "bottom")),
}
SYLLABLES = "ba be di do fu ga ke li lo ma ne no pa pe ra ri sa se ta to un ve en er an is ti on".split()


#: What readers write below articles, by hand.
REMARKS = (
    "Great piece, thanks for sharing.", "I disagree with the last point.", "Thank you, this helped me a lot!", "I tried this and it did not work for me.", "Nice article, but you forgot the second part.",
    "lol", "First!", "Totally agree.", "My brother says the same.", "Could you please write more about this?", "I love it!!", "Sorry, but I think this is wrong.", "We had the same problem last year.",
    "Thanks!", "You made my day.", "Does anyone know where I can find the figures?", "I've been reading you for years, cheers.", "Wow, awesome work.", "@Tom I agree with you.", "Anna wrote: thanks, I will try it.", "3 days ago",
    "Imo the author is right.", "Danke, das finde ich super.", "Ich sehe das anders, aber toll geschrieben.", "Merci, je suis d'accord.", "Je ne suis pas convaincu, moi.", "Gracias, estoy de acuerdo.", "Yo no lo creo.",
)


class Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(3, 18).capitalize()
        if self.rng.random() < 0.4:
            text = text.replace(" ", ", ", 1)
        return text + self.rng.choice("....?!")

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def texts(self, part: str) -> list[tuple[str, str]]:
        """(element, inner html) of the blocks of a part."""
        rng = self.rng
        if part == "article":
            out = [(rng.choice(("h1", "h2")), self.words(2, 10).capitalize())] if rng.random() < 0.8 else []
            for _ in range(rng.randint(2, 9)):
                kind = rng.random()
                if kind < 0.08:
                    out += [("li", self.prose(1, 1)) for _ in range(rng.randint(2, 4))]
                elif kind < 0.18:
                    out.append((rng.choice(("h2", "h3")), self.words(1, 6).capitalize()))
                elif kind < 0.26:
                    out.append(("blockquote", self.prose(1, 2)))
                else:
                    text = self.prose(1, 6) if rng.random() < 0.75 else self.words(1, 8) if rng.random() < 0.6 else rng.choice((self.words(15, 120), " ".join([self.word()] * rng.randint(10, 60)), self.prose(1, 3)[:-1]))
                    out.append(("p", text.replace(" ", rng.choice((" ", " <b>" + self.word() + "</b> ", " <a href='/x'>" + self.word() + "</a> ")), 1)))
            return out
        if part == "menu":
            return [("li", f'<a href="/{k}">{self.words(1, 3)}</a>') for k in range(rng.randint(3, 9))]
        if part == "sidebar":
            return [("h4", self.words(1, 3))] + [("li", f'<a href="/{k}">{self.words(2, 9)}</a>') for k in range(rng.randint(2, 6))]
        if part == "advert":
            return [("p", self.prose(1, 3))] if rng.random() < 0.7 else [("p", self.words(2, 6) + "!"), ("p", f"<a href='/buy'>{self.words(1, 3)}</a>")]
        if part == "notice":
            return [("p", self.prose(1, 2)), ("button", self.words(1, 2))]
        if part == "form":
            return [("label", self.words(1, 3) + ":"), ("button", self.words(1, 2))]
        if part == "comments":
            said = lambda: " ".join(rng.choice(REMARKS) for _ in range(rng.choice((1, 1, 2))))
            head = [("h3", self.words(1, 2))] if rng.random() < 0.6 else []
            own = rng.random() < 0.35
            return head + [(rng.choice(("p", "div")), self.prose(1, 3) if own else said() + (" " + self.sentence() if rng.random() < 0.4 else "")) for _ in range(rng.randint(1, 6))]
        return [("p", f"&copy; {rng.randint(1999, 2030)} {self.words(1, 4)}" if rng.random() < 0.6 else self.prose(1, 1))]

    def part(self, part: str, telling: float) -> tuple[str, list[int]]:
        rng = self.rng
        blocks = self.texts(part)
        elements, names = MARKS[part]
        if rng.random() >= telling:
            head, tag = f'<div class="{self.word()}">' if rng.random() < 0.5 else "<div>", "div"
        elif rng.random() < 0.5:
            tag = rng.choice(elements)
            head = f"<{tag}>"
        else:
            tag, name = rng.choice((("div",) * 3 + ("section",))), rng.choice(names)
            head = f'<{tag} {rng.choice(("class", "class", "id"))}="{name} {self.word()}">'
        inner = "".join(f"<{t}>{x}</{t}>" if t != "li" else f"<ul><li>{x}</ul>" for t, x in blocks)
        if part == "article" and len(blocks) > 3 and rng.random() < 0.3:
            # The parts of an article often stand in elements of their own.
            rows = [f"<{t}>{x}</{t}>" if t != "li" else f"<ul><li>{x}</ul>" for t, x in blocks]
            cut, box = rng.randint(1, len(rows) - 1), rng.choice(("div", "section", "header"))
            inner = f"<{box}>{''.join(rows[:cut])}</{box}>" + (f"<div>{''.join(rows[cut:])}</div>" if rng.random() < 0.5 else "".join(rows[cut:]))
        for _ in range(rng.choice((0, 0, 0, 1, 4))):
            inner = f'<div class="{self.word()}">{inner}</div>'
        return f"{head}{inner}</{tag}>", [int(part == "article")] * len(blocks)

    def page(self, telling: float) -> tuple[str, list[int]]:
        rng = self.rng
        before = [p for p in ("menu", "advert", "notice", "form", "sidebar") if rng.random() < 0.5]
        after = [p for p in ("comments", "sidebar", "advert", "menu", "footer") if rng.random() < 0.6]
        rng.shuffle(before)
        title = self.words(2, 8)
        html, labels = f"<html><head><title>{title}</title><style>p{{}}</style></head><body>", [0]
        for part in [*before, "article", *after]:
            more, label = self.part(part, telling)
            html, labels = html + more, labels + label
        return html + "</body></html>", labels


def labelled_pages(n: int = 600, seed: int = 1, telling: float = 0.75) -> list[tuple[str, list[int]]]:
    """(html, label of each leaf block); `telling` is the share of parts whose markup says what they are."""
    maker = Maker(random.Random(seed))
    return [maker.page(telling) for _ in range(n)]
