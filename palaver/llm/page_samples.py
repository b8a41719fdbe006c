"""Labelled web pages for training, by rule: the parts of a page in many arrangements, with or without telling markup."""

from __future__ import annotations

import random

from .dom import TOKENS

_SYLLABLES = (
    "an be ca de er fo gi ha in jo ka li mo ne or pu qui re sa ti un ve wa xi yo ze".split(),
    "ün sch ei bä ck tz uß ge en ach ich ver zu an".split(),
    "é ça où eau ê ll ou que in ez à on".split(),
    "ко ма ть ры на ши до ве".split(),
)


class Writer:
    """One page at a time; the texts that belong to its article are kept beside it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = self.r.choice([_SYLLABLES[0], *_SYLLABLES])
        self.plain = self.r.random() < 0.25  # a page whose class names tell nothing

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choices(self.syllables, k=self.r.randint(1, 3))) for _ in range(max(1, n)))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(self.r.randint(4, 16)).capitalize() + self.r.choice([".", ".", ".", "!", "?", ", so."]) for _ in range(n))

    def attribute(self, *kinds: str, telling: float = 0.65) -> str:
        """Mostly a telling class or id, sometimes one that tells nothing, sometimes none."""
        x = self.r.random()
        if x < 0.15:
            return ""
        token = self.r.choice(TOKENS[self.r.choice(kinds)].split()) if x < 0.15 + telling and not self.plain else self.words(1)
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice([token, token, "x-" + token, token + "-wrap", "c1 " + token])}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.words(1)}">{self.words(self.r.randint(1, 3))}</a></li>' for _ in range(n))

    def noise(self, kind: str) -> str:
        r, say = self.r, self.sentences
        if kind == "menu":
            tag, many = r.choice(["nav", "div", "nav", "div", "ul"]), self.links(r.randint(2, 9))
            return f"<{tag}{self.attribute('menu')}>{many if tag == 'ul' else '<ul>' + many + '</ul>'}</{tag}>" if r.random() < 0.8 else f"<div{self.attribute('menu')}>" + " | ".join(f'<a href="#">{self.words(1)}</a>' for _ in range(r.randint(2, 7))) + "</div>"
        if kind == "header":
            tag = r.choice(["header", "div"])
            return f"<{tag}{self.attribute('edge')}>{r.choice(['<h1>' + self.words(2) + '</h1>', '<a href=/>' + self.words(2) + '</a>', '<p>' + say(1) + '</p>'])}{r.choice(['', '<p>' + self.words(5) + '</p>'])}</{tag}>"
        if kind == "footer":
            tag = r.choice(["footer", "footer", "div"])
            return f"<{tag}{self.attribute('edge')}>{r.choice(['&copy; ' + self.words(3) + ' &middot; ' + say(1), '<p>' + say(r.randint(1, 2)) + '</p>', '<ul>' + self.links(3) + '</ul>', say(1)])}</{tag}>"
        if kind == "side":
            tag = r.choice(["aside", "div", "section"])
            a = self.attribute("side", telling=0.65 if tag == "aside" else 0.85)
            return f"<{tag}{a}><h3>{self.words(2)}</h3>{r.choice(['<ul>' + self.links(r.randint(2, 6)) + '</ul>', '<p>' + say(r.randint(1, 4)) + '</p>', '<p>' + say(2) + '</p><p>' + say(1) + '</p>'])}</{tag}>"
        if kind == "form":
            a = r.choice(["", self.attribute("form")])
            return f"<form{a}><label>{self.words(2)}</label><input name=q>{r.choice(['', '<textarea>' + self.words(3) + '</textarea>', '<select><option>' + self.words(1) + '<option>' + self.words(2) + '</select>'])}<button>{self.words(1)}</button>{r.choice(['', '<p>' + say(1) + '</p>'])}</form>"
        if kind == "talk":
            unit = r.choice(["<li><p>{}</p></li>", "<div class=comment><b>x</b><p>{}</p></div>", "<p>{}</p>", "<div class=u1><span>{a}</span> <p>{}</p></div>", "<li class=u2>{a}<br>{}</li>", "<div class=u3><h4>{a}</h4>{}</div>", "<article class=u4><p>{}</p></article>", "{} "])
            own = "".join(unit.format(say(r.randint(1, 5)), a=self.words(2) + r.choice(["", " 12:30", ", 3.4.2021"])) for _ in range(r.randint(1, 7)))
            tag = r.choice(["div", "section", "ol", "aside"])
            a = f' {r.choice(["class", "id"])}="{self.words(1) if self.plain or r.random() < 0.15 else r.choice(TOKENS["talk"].split())}"'
            return f'<{tag}{a}>{r.choice(["", "<h3>" + self.words(2) + "</h3>", "<h2>" + self.words(1) + "</h2>"])}{own}</{tag}>'
        a = f' {r.choice(["class", "id"])}="{self.words(1) if self.plain or r.random() < 0.15 else r.choice(TOKENS[kind].split())}"'
        return f"<div{a}>{r.choice([say(r.randint(1, 3)), self.words(3) + '! ' + self.words(1), '<p>' + say(r.randint(1, 3)) + '</p>', '<p>' + self.words(8) + '</p><a href=#>' + self.words(2) + '</a>'])}</div>"

    def article(self) -> tuple[str, list[str]]:
        r, out, texts = self.r, [], []

        def block(tag: str, text: str) -> None:
            x = r.random()
            inner = f"<b>{text}" if x < 0.1 else f"{text.partition(' ')[0]} <a href=#>{text.partition(' ')[2]}</a>" if x < 0.15 and len(text) < 60 else text
            out.append(f"<{tag}>{inner}{'<br>' if r.random() < 0.1 else ''}" + ("" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>"))
            texts.append(" ".join(text.split()))

        if r.random() < 0.85:
            block(r.choice(["h1", "h1", "h2"]), self.words(r.randint(2, 12)))
        lines = r.random() < 0.05  # an article of lines without paragraphs
        if lines:
            texts.append(" ".join(self.sentences(r.randint(2, 5)) for _ in range(r.randint(2, 6))))
            out.append(texts[-1].replace(". ", ".<br><br>"))
        for _ in range(0 if lines else r.choice([1, 1, 2, 3, 5, 9, 14])):
            x = r.random()
            if x < 0.75:
                block("p", self.sentences(r.choice([1, 1, 2, 3, 6, 10])) if r.random() < 0.93 else self.words(r.randint(1, 4)))
            elif x < 0.82:
                block(r.choice(["h2", "h3"]), self.words(r.randint(1, 6)))
            elif x < 0.88:
                out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    block("li", self.sentences(1))
                out.append("</ul>")
            elif x < 0.92:
                block(r.choice(["blockquote", "pre"]), self.sentences(r.randint(1, 3)))
            elif x < 0.95:
                block("div", self.sentences(r.randint(1, 4)))
            else:
                out.append(self.noise(r.choice(["advert", "notice", "side", "form"])))
        inner = "".join(out)
        wrap = r.random()
        if wrap < 0.45:
            return f"<article{r.choice(['', '', self.attribute('main')])}>{inner}</article>", texts
        if wrap < 0.6:
            return f"<main{r.choice(['', self.attribute('main')])}>{inner}</main>", texts
        if wrap < 0.92:
            return f'<div {r.choice(["class", "id"])}="{self.words(1) if self.plain else r.choice(TOKENS["main"].split())}">{inner}</div>', texts
        return f"<div>{inner}</div>", texts

    def page(self) -> tuple[str, list[str]]:
        """A page, and the texts of its article's blocks."""
        r = self.r
        body, texts = self.article()
        kinds = ["menu", "header", "advert", "notice", "form", "side"]
        head = [self.noise(k) for k in kinds if r.random() < (0.7 if k == "menu" else 0.3)]
        r.shuffle(head)
        tail = [self.noise(k) for k in ("talk", "side", "advert", "form", "menu", "notice") if r.random() < 0.3]
        r.shuffle(tail)
        tail += [self.noise("footer")] if r.random() < 0.75 else []
        if r.random() < 0.3:
            body = f"<div{r.choice(['', ' class=container', ' id=wrapper'])}>{body}{tail.pop(0) if tail and r.random() < 0.5 else ''}</div>"
        inner = "".join(head) + body + "".join(tail)
        if r.random() < 0.1:
            inner = f"{''.join(head[1:])}<table><tr><td>{''.join(head[:1])}</td><td>{body}</td></tr></table>{''.join(tail)}"
        if r.random() < 0.25:
            inner = f"<div class={r.choice(['container', 'layout', 'site', 'wrap'])}>{inner}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style></head><body>{inner}" + ("</body></html>" if r.random() < 0.9 else ""), texts
