"""Personal information in free text: patterns propose spans, checksums confirm them, the words around them decide.

Every proposal has a base score by its form. Words nearby in the same sentence that announce such a value raise it; words
that announce something else (orders, cases, models, prices) lower it. A checksum that holds decides: mod 11 (tax numbers)
and mod 23 (identity numbers) lift a proposal over the threshold without any word, Luhn (cards) and mod 97 (account numbers)
make a payment number of it, which no phone or identity number may overlap. One that fails decides nothing, as numbers
are mistyped and made up. Spans that reach the threshold and do not overlap a better one are reported or replaced by a
placeholder of their type; the rest of the text is untouched. Payment numbers are replaced too, but are none of KINDS.

Null and empty texts have no spans and stay as they are. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]", "payment": "[PAYMENT]"}
THRESHOLD = 0.5

# Same length as the original, so that offsets hold.
_FOLD = {0xFF20: "@", 0xFE6B: "@", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x00A0: " ", 0x202F: " ", 0x2009: " "} | {0xFF10 + d: str(d) for d in range(10)}

_FOLDABLE = re.compile("[" + "".join(map(chr, _FOLD)) + "]")

# Fixed word lists: cues and given names in Portuguese, Spanish and English.
ID_CUES = r"cpf|rg|cnpj|identidade|identidad|identity|documento|document|passaporte|pasaporte|passport|dni|nie|nif|ssn|social security|seguridad social|id card|id number|tax id|cadastro|ficha|formul[áa]rio|form|boleto|recibo|receipt|vaz(?:ou|aram)|filtr(?:[óo]|aron)|leak(?:ed)?"
PHONE_CUES = r"tel|telefone|tel[ée]fono|phone|call|text|liga|ligar|ll[áa]ma|llamar|llama|chama|zap|whats|whatsapp|celular|m[óo]vil|mobile|n[úu]mero [ée]|n[úu]mero es|number is|golp\w+|estaf\w+|scam\w*|recado|contato|contacto|contact"
PHONE_AFTER = r"recado|depois das|despu[ée]s de las|after|whats\w*|zap"
OTHER_CUES = r"pedido|order|orden|protocolo|protocol|ticket|processo|proceso|case|caso|modelo|model|isbn|rastreio|rastreo|tracking|vers[ãa]o|versi[óo]n|version|placar|p[úu]blico|recorde|r[ée]cord|record|r\$|us\$|€|cep|c[óo]digo|code|nota fiscal|fatura|invoice|serial|s[ée]rie"
FICTION_CUES = r"personagem|personaje|character|capit[ãa]o|capit[áa]n|captain|hero[íi]?|vil[ãa]o|villano|villain|jogador|jugador|player|time|team|equipo|livro|libro|book|filme|pel[íi]cula|movie|novela"
PLACE_CUES = r"rua|avenida|av|calle|pra[çc]a|plaza|travessa|estrada|escola|escuela|school|col[ée]gio|hospital|est[áa]dio|stadium|bairro|barrio|street|road"
# What comes before the name of a person: titles, introductions, signatures, roles, contact.
NAME_CUES = (
    r"sr|sra|srta|dona|do[nñ]a|dr|dra|mr|mrs|ms|prof|profa|nome [ée]|chamo|nombre es|llamo|name is|called|att|atte|assinado|firmado|signed|regards|sincerely|abra[çc]os|saludos|em nome de|en nombre de|on behalf of|"
    r"atend\w+|helped|served|falar|fale|falei|fala|habl\w+|talk|talked|speak|spoke|procur\w+|busc(?:ar|a|o) a|ask for|conhece\w*|conoce\w*|met|"
    r"s[íi]ndic[oa]|administrador\w*|vizinh[oa]|vecin[oa]|neighbou?r|caser[oa]|landlord|landlady|gerente|manager|atendente|vendedor\w*|seller|motorista|driver|chefe|jef[ea]|boss|colega|amig[oa]|friend"
)
# Of these, those that are followed by a full name even if its given name is none of the list.
NAME_INTRODUCTIONS = r"meu nome [ée]|me chamo|mi nombre es|me llamo|my name is|i am called|sr|sra|srta|mr|mrs|ms|dra?|assinado|firmado|signed"
# What a person does, after the name.
NAME_AFTER = r"(?:n[ãa]o |no |nunca |never |does not |ainda )?(?:me |te |se |le |lhe |nos )?(?:dev[eo]\w*|deb[eí]\w*|owes?|respond\w+|mora|vive|lives|atend\w+|trabalh\w+|trabaj\w+|works?|lig[ao]\w*|llam\w+|calls?|called|escrev\w+|escrib\w+|writes|wrote|disse|dijo|said|vend\w+|sells|sold)\b"
GIVEN_NAMES = """
adriana agnes alberto alice aline alan amanda amy ana anarita andre andrea andres angela anna anne antonia antonio arthur augusto barbara beatriz benedita bernardo bianca
brian bruna bruno caio camila carla carlos carmen carol carolina caroline catarina cecilia celia charles charlotte christine clara clarice claudia claudio clara cristina dalva daniel daniela david
davi debora denise diana diego edith edu eduardo elena elias elisa elizabeth elsa elvira emilia emily emma enrique erica ernesto esteban esther eva fabio fatima felipe fernanda fernando
flavia flavio francisca francisco frank gabriel gabriela george geraldo gilberto gloria grace graham gustavo hector helen helena henry henrique hugo iara ignacio igor ines irene isabel isabela ivan
jack jaime james jane javier jean joan joana joao joaquim joaquin john jorge jose joseph juan julia juliana julio jussara karen kate larissa laura leandro leonardo leticia lidia lilian linda lorena
lourdes lucas lucia luciana luis luisa luiz manuel manuela marcela marcelo marcia marco marcos margaret margarita maria mariana marina mario marta martha martin mary mateo mateus maria matilde mauricio
mercedes michael miguel milton monica murilo nancy natalia nelson nicolas nina noemia nora norma olga olivia oscar otavio pablo patricia paula paulo pedro peter philip pilar priscila rafael raquel ramon
raul rebeca regina renata renato ricardo rita robert roberto rodrigo rogerio rosa rosario ruth samuel sandra sara sergio silvia simon simone sofia sonia stella susan susana tatiana teresa thomas tomas
valentina valeria vanessa vera veronica vicente victor vinicius violeta vitor wagner walter wanda william yara zilda
""".split()

_CLOSE = r"(?![\w@]|[-/.]\d)"
_OPEN = r"(?<![\w@.,/+-])"
_DOT = r"(?:\s?\.\s?|\s*(?:\[dot\]|\(dot\)|\[ponto\]|\(ponto\)|\[punto\]|\(punto\))\s*|\s+(?:ponto|punto|dot)\s+)"
_AT = r"(?:\s*(?:\(arroba\)|\[arroba\]|\(at\)|\[at\])\s*|\s+arroba\s+)"
EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]*\w@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}", re.I)
EMAIL_SPELT = re.compile(rf"(?<![\w.+-])[\w.+-]*\w{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}", re.I)

PHONE = re.compile(
    _OPEN
    + r"(?:(?P<intl>\+\d{1,3}[ .-]?\(?\d{2,3}\)?[ .-]?(?:9[ .-]?)?\d{3,5}[ .-]?\d{4})"
    r"|(?P<area>\(0?\d{2,3}\)[ .-]?(?:9 )?\d{3,5}[ .-]?\d{4})"
    r"|(?P<trunk>0\d{2} (?:9 )?\d{4,5}[- .]\d{4})"
    r"|(?P<nine>\d{2} 9 \d{4}[- .]\d{4})"
    r"|(?P<spaced>\d{2}[ .]\d{4,5}[ .-]\d{4})"
    r"|(?P<north>\d{3}[ .-]\d{3}[ .-]\d{4})"
    r"|(?P<dashed>\d{2}-\d{4,5}-\d{4})"
    r"|(?P<local>\d{4,5}-\d{4})"
    r"|(?P<code>55\d{10,11})"
    r"|(?P<bare>\d{10,11}))" + _CLOSE
)
_PHONE_BASE = {"intl": 0.7, "area": 0.6, "trunk": 0.5, "nine": 0.5, "spaced": 0.4, "north": 0.4, "dashed": 0.2, "local": 0.2, "code": 0.35, "bare": 0.15}
ID_NUMBER = re.compile(
    _OPEN
    + r"(?:(?P<cpf>\d{3}\.\d{3}\.\d{3}[-/.]\d{2}|\d{9}-\d{2})"
    r"|(?P<cpf_spaced>\d{3} \d{3} \d{3} \d{2})"
    r"|(?P<cnpj>\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})"
    r"|(?P<rg>\d{2}\.\d{3}\.\d{3}-[\dxX])"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<ssn_spaced>\d{3} \d{2} \d{4})"
    r"|(?P<dni>[xyzXYZ]?-?\d{7,8}-?[a-zA-Z]|\d{1,2}\.\d{3}\.\d{3}-?[a-zA-Z])"
    r"|(?P<passport>[a-zA-Z]{2}\d{6,7})"
    r"|(?P<iban>[a-zA-Z]{2}\d{2}(?: ?[\dA-Z]{4}){3,7}(?: ?[\dA-Z]{1,3})?)"
    r"|(?P<card>\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})"
    r"|(?P<bare>\d{7,11}))" + _CLOSE
)
_ID_BASE = {"cpf": 0.6, "cpf_spaced": 0.4, "cnpj": 0.5, "rg": 0.55, "ssn": 0.5, "ssn_spaced": 0.2, "dni": 0.35, "passport": 0.15, "iban": 0.2, "card": 0.1, "bare": 0.1}

_NOT_NAME = r"(?!(?:[àa]s|aos?|tem|que|eu|com|por|para|pra|na|no|em|fui|faz|uma?|[ée]|foi|est[áa]|at[ée]|el|los|las|hay|con|en|y|and|the|for|in|on|at|was|is|of)\b)"
_WORD = r"[^\W\d_][\w'’]*\.?"
STREET = re.compile(
    r"(?<![\w@])(?:rua|r\.|avenida|av\.?|avda\.?|travessa|trav\.|tv\.|alameda|al\.|estrada|estr\.|rodovia|rod\.|pra[çc]a|largo|calle|c/|plaza|paseo)(?:(?<=[./])\s*|\s+)"
    rf"(?:(?:d[aeo]s?|del|de\s+l[ao]s?)\s+)?{_NOT_NAME}{_WORD}(?:\s+{_NOT_NAME}{_WORD}){{0,4}}?\s*,?\s*"
    r"(?:n[º°o]?\.?\s*|n[úu]mero\s+|num\.?\s*|#\s*)?(?P<no>\d{1,5})(?!\w|[:%]|[.,]\d|\s*(?:h\b|horas?|reais|anos|dias))"
    r"(?:\s*,?\s*(?:apto\.?|apartamento|ap\.|bloco|bl\.|casa|piso|sala|cj\.)\s*\w+)*(?:\s*-\s*[^\W\d_][\w .'’]{2,30}?\s*-\s*CEP\s*\d{5}-?\d{3})?",
    re.I,
)
STREET_EN = re.compile(
    r"(?<![\w@.,$-])\d{1,5}\s+" + rf"{_NOT_NAME}{_WORD}(?:\s+{_NOT_NAME}{_WORD}){{0,2}}\s+(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|boulevard|blvd|way|place|pl|terrace)\b"
    r"(?:\s*,?\s*(?:apt|suite|unit|flat)\.?\s*\w+)?"
    rf"|\bnumber\s+\d{{1,5}},?\s+{_NOT_NAME}{_WORD}(?:\s+{_NOT_NAME}{_WORD}){{0,2}}\s+(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|boulevard|blvd|way|place|pl|terrace)\b",
    re.I,
)
_STREET_EN_NOT = re.compile(r"\b(?:dollars?|days?|pesos|reais|years?|people|percent|minutes?|hours?|weeks?|months?|points?)\b", re.I)

_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PARTICLES = frozenset(("de", "da", "do", "dos", "das", "del", "la"))
_LINKING = r"(?:\W|\b(?:o|a|os|as|el|la|the|foi|fue|was|is|[ée]|es|com|con|with|to|by|por|de|for)\b){0,8}"
_NAME_BEFORE = re.compile(rf"(?<!\w)(?:{NAME_CUES}){_LINKING}$", re.I)
_NAME_AFTER = re.compile(rf"\s+{NAME_AFTER}", re.I)
_INTRODUCED = re.compile(rf"(?<!\w)(?:{NAME_INTRODUCTIONS})\b[.,:]?\s+(?=[^\W\d_]{{3}})", re.I)
_INTRODUCED_HINTS = ("nome ", "chamo", "nombre", "llamo", "name is", "am called", "sr", "mr", "ms", "dr", "assinado", "firmado", "signed")  # in every match
_PLACE_BEFORE = re.compile(rf"(?<!\w)(?:{PLACE_CUES})\b[^\n.!?]{{0,12}}$", re.I)
_SENTENCE_END = re.compile(r"(?<=[^\W_]{2})[.!?…]+\s|\n")
_GIVEN = frozenset(GIVEN_NAMES)
_ANY_CUE = {k: re.compile(rf"(?<![^\W_])(?:{v})(?![^\W_])" if k != "other" else rf"(?:{v})", re.I) for k, v in (("id", ID_CUES), ("phone", PHONE_CUES), ("phone after", PHONE_AFTER), ("other", OTHER_CUES), ("fiction", FICTION_CUES))}
_HAS_EN_STREET = re.compile(r"\b(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|boulevard|blvd|way|place|pl|terrace)\b", re.I)
_STREET_HINTS = ("rua", "r.", "av", "trav", "tv.", "alameda", "al.", "estr", "rod", "pra", "largo", "calle", "c/", "plaza", "paseo")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def luhn_holds(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return len(digits) > 11 and total % 10 == 0


def mod97_holds(code: str) -> bool:
    code = re.sub(r"\W", "", code).upper()
    turned = code[4:] + code[:4]
    return 15 <= len(code) <= 34 and turned.isalnum() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def weighted_mod11_holds(digits: str) -> bool:
    """Two check digits, each a weighted sum mod 11 (tax numbers of 11 digits of persons, of 14 of companies)."""
    if len(digits) not in (11, 14) or len(set(digits)) == 1:
        return False
    for n in (len(digits) - 2, len(digits) - 1):
        weights = range(n + 1, 1, -1) if len(digits) == 11 else [(n - 1 - i) % 8 + 2 for i in range(n)]
        rest = sum(int(d) * w for d, w in zip(digits, weights)) * 10 % 11 % 10
        if rest != int(digits[n]):
            return False
    return True


def letter23_holds(code: str) -> bool:
    """Eight digits and the letter of their remainder by 23."""
    code = re.sub(r"\W", "", code).upper()
    code = {"X": "0", "Y": "1", "Z": "2"}.get(code[:1], code[:1]) + code[1:]
    return len(code) == 9 and code[:8].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(code[:8]) % 23] == code[8]


def _around(text: str, a: int, z: int, before: int = 34, after: int = 26) -> tuple[str, str]:
    """The words next to a span, within its own sentence. A dot after one letter ends none."""
    left, right = text[max(0, a - before) : a], text[z : z + after]
    cut = max((e.end() for e in _SENTENCE_END.finditer(left)), default=0)
    left = left[cut:]
    end = _SENTENCE_END.search(right)
    return left, right[: end.start()] if end else right


def _nearest(cue: re.Pattern, left: str) -> int:
    """Distance from the end of left to the last match, or a large number."""
    last = 999
    for m in cue.finditer(left):
        last = len(left) - m.end()
    return last


def _numbers(text: str, want: set[str]) -> Iterator[Span]:
    for kind, pattern, base in (("phone", PHONE, _PHONE_BASE), ("id_number", ID_NUMBER, _ID_BASE)):
        if kind not in want:
            continue
        for m in pattern.finditer(text):
            form = m.lastgroup
            left, right = _around(text, *m.span())
            score = base[form]
            digits = re.sub(r"\D", "", m.group())
            other, phone, own = (_nearest(_ANY_CUE[c], left) for c in ("other", "phone", "id"))
            close = min(other, phone, own)
            if other <= 12 and other == close:
                score -= 0.6
            if kind == "phone":
                if form == "dashed" and other < 30:
                    score -= 0.4
                if phone == close and phone < 20 or _ANY_CUE["phone after"].match(right.lstrip(" ,;:(-")):
                    score += 0.45
                if own == close and own < 8:
                    score -= 0.5
                if form == "bare" and (len(digits) not in (10, 11) or weighted_mod11_holds(digits)):
                    score -= 0.3
            elif form in ("card", "iban"):
                # payment numbers are no identity numbers, and are sure only by their check digits
                if luhn_holds(digits) if form == "card" else mod97_holds(m.group()):
                    yield Span(*m.span(), "payment", 1.0)
                continue
            else:
                if own == close and own < 20 or own > 20 and _nearest(_ANY_CUE["id"], right[:20]) < 999:
                    score += 0.45
                if phone == close and phone < 8 and phone < own:
                    score -= 0.5
                if form == "bare" and len(digits) not in (8, 9, 11) or form == "dni" and len(digits) < 7:
                    score -= 0.3
                if form == "passport" and own >= 12:
                    score -= 0.3
                if form != "passport" and weighted_mod11_holds(digits) or form == "dni" and letter23_holds(m.group()):
                    score += 0.45
            if score >= THRESHOLD:
                yield Span(*m.span(), kind, min(1.0, score))


def _emails(text: str) -> Iterator[Span]:
    for pattern, score in ((EMAIL, 0.95), (EMAIL_SPELT, 0.85)):
        for m in pattern.finditer(text):
            yield Span(*m.span(), "email", score)


def _addresses(text: str, low: str) -> Iterator[Span]:
    if any(h in low for h in _STREET_HINTS):
        for m in STREET.finditer(text):
            left, _ = _around(text, *m.span(), 16)
            score = 0.6 + 0.2 * bool(re.search(r"\b(?:moro|vivo|endere[çc]o|entrego|fica|frente|direcci[óo]n|live)\b", left, re.I))
            inside = text[m.start() : m.start("no")]
            if re.search(r"(?:r\$|\$)\s*$", inside, re.I):
                score = 0.0
            if score >= THRESHOLD:
                yield Span(*m.span(), "address", score)
    if _HAS_EN_STREET.search(text):
        for m in STREET_EN.finditer(text):
            if not _STREET_EN_NOT.search(m.group()):
                yield Span(*m.span(), "address", 0.7)


class _Given(dict):
    """Whether a lower-case word is a given name, with or without accents. Remembers what it met, up to a bound."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = (word if word.isascii() else plain(word)) in _GIVEN
        return got


_IS_GIVEN = _Given()
_QUICK_WORD = re.compile(r"[^\W\d_]{3,}")


def _style(word: str) -> int:
    """0 for lower case, 1 for a capital, 2 for capitals only."""
    return 2 if len(word) > 1 and word.isupper() else 1 if word[0].isupper() else 0


def _surnames(text: str, words: list[re.Match], at: int, style: int) -> int:
    """How many words from `at` on are surnames, with particles and one initial; the number of the word after the last one."""
    last, found = at, 0
    while at < len(words):
        gap = text[words[at - 1].end() : words[at].start()]
        word = words[at].group()
        if gap != " " and not (gap == ". " and len(words[at - 1].group()) == 1):
            break
        if len(word) == 1 and not found and text[words[at].end() : words[at].end() + 2] == ". ":
            at += 1
        elif word.lower() in _PARTICLES and found:
            at += 1
        elif len(word) > 2 and (_style(word) == style if style != 1 else _style(word) > 0) and (not found or style == 1 or words[at - 1].group().lower() in _PARTICLES):
            at, found, last = at + 1, found + 1, at + 1
            if found == 4:
                break
        else:
            break
    return last if found else 0


def _names(text: str, low: str) -> Iterator[Span]:
    """Given names of the list with a surname after them, or before them and a comma; other full names after an introduction."""
    for cue in _INTRODUCED.finditer(text) if any(h in low for h in _INTRODUCED_HINTS) else ():
        m = _NAME_WORD.match(text, cue.end())
        if m and _style(m.group()) == 1 and not _IS_GIVEN[m.group().lower()]:
            words = [m, *_NAME_WORD.finditer(text, m.end(), m.end() + 80)]
            end = _surnames(text, words, 1, 1)
            if end:
                yield Span(m.start(), words[end - 1].end(), "name", 0.55)
    if not any(map(_IS_GIVEN.__getitem__, _QUICK_WORD.findall(low))):
        return
    words = list(_NAME_WORD.finditer(text))
    given = [i for i, m in enumerate(words) if _IS_GIVEN[m.group().lower()]]
    done = -1
    for i in given:
        if i <= done:
            continue
        first, style = i, _style(words[i].group())
        after = i + 1
        while after in given and text[words[after - 1].end() : words[after].start()] == " ":
            after += 1
        end = _surnames(text, words, after, style)
        turned = False
        if not end and after - i > 1:  # the last of several given names may be the surname
            end = after
        if not end and i and text[words[i - 1].end() : words[i].start()] == ", " and len(words[i - 1].group()) > 2 and _style(words[i - 1].group()) == style:
            first, end, turned = i - 1, after, True
            while first > 1 and words[first - 1].group().lower() in _PARTICLES and _style(words[first - 2].group()) == style and text[words[first - 2].end() : words[first].start()].strip().lower() in _PARTICLES:
                first -= 2
            if first and len(words[first - 1].group()) == 1 and text[words[first - 1].end() : words[first].start()] == ". ":
                first -= 1
        if not end:
            continue
        a, z = words[first].start(), words[end - 1].end()
        left, right = _around(text, a, z)
        # a given name and a surname in capitals are a name; in lower case or turned round they need a word that says so
        score = 0.35 + 0.2 * (style > 0 and not turned)
        if _NAME_BEFORE.search(left):
            score += 0.3
        if _NAME_AFTER.match(right):
            score += 0.25
        if _ANY_CUE["fiction"].search(left) or _PLACE_BEFORE.search(left):
            score -= 0.6
        if score >= THRESHOLD:
            yield Span(a, z, "name", min(1.0, score))
            done = end - 1


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text, in order, without overlaps: the better score wins, then the longer span."""
    if not text:
        return []
    folded = text.translate(_FOLD) if _FOLDABLE.search(text) else text
    low = folded.lower()
    found: list[Span] = []
    if "@" in folded or "arroba" in low or "(at)" in low or "[at]" in low:
        found += _emails(folded)
    digits = sum(map(folded.count, "0123456789"))
    if digits >= 6:
        found += _numbers(folded, {"phone", "id_number"})
    if digits:
        found += _addresses(folded, low)
    found += _names(folded, low)
    if len(found) < 2:
        return found
    kept: list[Span] = []
    for s in sorted(found, key=lambda s: (-s.score, s.start - s.end, s.start, s.kind)):
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by the placeholder of its kind; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for s in find_spans(text):
        out += [text[at : s.start], PLACEHOLDER[s.kind]]
        at = s.end
    return "".join(out) + text[at:]


def kinds_found(texts: DataFrame) -> DataFrame:
    """(record, id, kind) for texts (record, id, text): one row for each kind in each message, over all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for record, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text:
                    rows += [(record, key, kind) for kind in {s.kind for s in find_spans(text)} if kind in KINDS]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names=["record", "id", "kind"])

    return texts.select("record", "id", "text").mapInArrow(run, "record string, id string, kind string").distinct()


def redacted(texts: DataFrame) -> DataFrame:
    """(record, id, text, n_spans) with placeholders; one row for each row of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            spans = [len(find_spans(t)) for t in texts]
            done = [redact(t) if n else t for t, n in zip(texts, spans)]
            columns = [batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string()), pa.array(done, pa.string()), pa.array(spans, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["record", "id", "text", "n_spans"])

    return texts.select("record", "id", "text").mapInArrow(run, "record string, id string, text string, n_spans int")
