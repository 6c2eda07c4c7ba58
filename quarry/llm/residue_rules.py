"""What rules alone recognise as residue, and the forms of a passage in which likeness finds the rest.

A passage is a sentence of running text, or one line of a list, table or template. Sections shown as code
(code, nowiki, pre, syntaxhighlight, math) and comments are no content and are cut out first.

The rules are general and few: the syntax of template languages, log and status lines, and notices. A notice
is told by a core statement (scripts must be enabled, a page cannot be found, a text is still to come) in a
passage that has hardly a word besides the vocabulary of user interfaces: running text on the same subject
has words of its own. Everything else is left to likeness, see `residue`: words that stand where a near-duplicate
has a value (frames), and filler text, of which only the public words are known here.
"""

from __future__ import annotations

import re
import unicodedata

_CODE = re.compile(r"<!--.*?(?:-->|\Z)|<(code|nowiki|pre|syntaxhighlight|source|math|tt|kbd|samp)\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))", re.S | re.I)
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
_ENTITY = re.compile(r"&(?:nbsp|#160|#xa0|ensp|emsp|thinsp);", re.I)
_LINEWISE = re.compile(r"\s*(?:[|!*#:;{}]|\[\[(?:category|kategorie|catégorie|categoría):)", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’'»)]*\s+(?=\S)")
_BLOCK = re.compile(r"\n[^\S\n]*\n")

# Names of tags that are no placeholders when written in capitals, and page switches.
TAGS = (
    "A B BIG BLOCKQUOTE BR CENTER CITE CODE DD DEL DIV DL DT EM ERROR FONT GALLERY H1 H2 H3 H4 HR I INCLUDEONLY INS KBD LI MATH NOINCLUDE"
    " NOSCRIPT NOWIKI OL ONLYINCLUDE P POEM PRE Q REF REFERENCES S SAMP SCORE SCRIPT SMALL SOURCE SPAN STRIKE STRONG STYLE SUB SUP"
    " SYNTAXHIGHLIGHT TABLE TD TH TR TT U UL VAR"
).split()
SWITCHES = "TOC NOTOC FORCETOC NOEDITSECTION NEWSECTIONLINK NONEWSECTIONLINK NOINDEX INDEX NOGALLERY HIDDENCAT STATICREDIRECT NOTITLECONVERT NOCONTENTCONVERT DISAMBIG".split()
#: Words a field in square brackets ends with.
FIELDS = "name|date|year|month|day|time|title|company|city|town|country|address|place|location|number|amount|price|email|phone|author|subject|topic|description|text|value|url|link"
# Fields a script did not fill, by the syntax of common template languages.
PLACEHOLDERS = (
    r"\{\{\{[^{}\n]*\}\}\}",
    r"\$\{[^{}\n]*\}",
    r"<%=?[^%\n]*%>",
    r"\{% ?\w[^%\n]*%\}",
    r"\{\{ [\w.]+ \}\}",
    r"(?<![\w^{$\\])\{[a-z][a-z0-9]+(?:_[a-z0-9]+)*\}(?!\})",
    r"@@\w+@@",
    r"%[A-Za-z][A-Za-z_]{2,}\d*%",
    r"\[(?:insert|enter|your|add)\b[^\]\n]*\](?!\()",
    r"(?<!\[)\[[\w ]{1,30} (?:TBD|TBA|TBC)\]",
    r"(?<!\[)\[(?:[A-Z][a-z]+ )?(?:" + "|".join(f.capitalize() for f in FIELDS.split("|")) + r")\](?![(\]])",
    r"\[object Object\]",
    r"#(?:REF|VALUE|DIV/0|NAME)[!?]",
)
#: What a failed script may write for a value, and marks of fields that mean other things elsewhere (sets, keys, macros, tags):
#: residue only where likeness shows that a value belongs there.
AMBIGUOUS = (
    r"\bundefined\b",
    r"\bNaN\b",
    r"\bNone\b",
    r"\bnull\b|\bNULL\b",
    r"\bnil\b",
    r"\bXXX+\b",
    r"#[A-Z][A-Z_]+\d*#",
    r"__(?!(?:" + "|".join(SWITCHES) + r")__)[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__",
    r"<(?!(?:" + "|".join(TAGS) + r")>)[A-Z][A-Z0-9_]+>",
    r"(?<![\w^{$\\])\{\d\}(?!\})",
)
#: Kinds whose labels do not spread.
UNFILLED = ("placeholder", "value")
# Distinctive words of the public filler text and its usual generators.
FILLER_WORDS = frozenset(
    "lorem ipsum dolor amet consectetur consectetuer adipiscing elit eiusmod tempor incididunt labore dolore aliqua minim veniam nostrud"
    " exercitation ullamco laboris aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat pariatur excepteur"
    " occaecat cupidatat proident deserunt mollit laborum vestibulum pellentesque condimentum fermentum tristique ultrices orci nunc nibh"
    " tempus vivamus curabitur phasellus suspendisse".split()
)

# Logs, status lines and error objects: syntax, so no vocabulary is asked for.
_LOG = re.compile(
    r"^(?:php )?(?:fatal|parse|syntax|uncaught|runtime|warning|notice|unhandled)[ :]+(?:\w*error|\w*exception|undefined)\b"
    r"|^traceback \(most recent call last\)|\bon line \d+$|^\W*\"?errors?\"?: ?[{\[]|^<error\b[^>]*\b(?:code|info|message)=|^\W*exception in thread\b"
    r"|^(?:(?:http|error|fehler|erreur)[ /\d.:]{0,7})?[45]\d\d\W{0,3} ?(?:not found|forbidden|unauthori[sz]ed|bad (?:request|gateway)|service unavailable"
    r"|internal server error|gateway time-?out|request time-?out|too many requests|method not allowed|gone)\b"
    r"|^could not connect to\b|\bconnection refused$|^<noscript>"
)
#: Notes to oneself, and one word over and over: syntax as well.
_NOTE = re.compile(r"^(?:todo|to do|fixme|tbd)\s?[:(]|^(\w{0,10}text[eo]?|blah|bla)(?:\W+\1\b){2,}\W*$")
#: Core statements of notices, on folded text, by kind and language.
_SCRIPT = r"java ?scripts?|js|scripts?|scripting|cookies?|skripte"
_SWITCH = (
    r"enabl\w+|activat\w+|turn\w*|switch\w*|allow\w*|requir\w+|needs?|support\w*|disabl\w+|block\w+|without"
    r"|aktivier\w+|deaktiviert|ohne|erforderlich|benotigt|zulassen|activ\w+|desactiv\w*|necessit\w*|requi\w+|sans|autorise\w*"
    r"|habilit\w+|necesita|desactivado|sin|permit\w+|bloque\w+"
)
CORES = {
    "script notice": (
        rf"\b(?:{_SCRIPT})\b.*\b(?:{_SWITCH})\b|\b(?:{_SWITCH})\b.*\b(?:{_SCRIPT})\b",
        r"\b(?:checking|verifying|updat\w+|upgrad\w+|outdated|unsupported)\b.*\bbrowser\b|\bbrowser\b.*\b(?:outdated|unsupported|not supported|out of date)\b",
    ),
    "error": (
        r"(?:\bnot|n't) (?:be )?(?:found|available|exist|working|reachable|accessible|respond\w*|answer\w*|displayed|loaded|reached|opened|completed|processed|authori[sz]ed)\b",
        r"^(?:bad gateway|gateway time-?out|(?:service|temporarily) unavailable|internal server error|too many requests|access (?:denied|forbidden)|forbidden)\b",
        r"\b(?:no longer|un) ?(?:exists?|available)\b|\binaccessible\b|\bunable to (?:complete|process|handle|load|find|connect)\b|\bencountered an? (?:\w+ )?error\b",
        r"\b(?:access|permission|request) (?:is |was |has been )?(?:denied|refused|rejected|failed|blocked)\b|\b(?:do|does|did)(?: not|n't) have (?:the )?(?:permission|access|rights)\b",
        r"\bhas (?:moved|expired|ended|timed out)\b|\bhave been (?:logged|signed) out\b|\btime[ds]? ?-?out\b|\b(?:log|sign) in (?:again )?to (?:continue|proceed)\b",
        r"\b(?:went|gone|going) wrong\b|\b(?:an?|unexpected|internal|database) error (?:has )?occurred\b|\btechnical (?:difficult\w+|problems?|issues?)\b|\b(?:error|fehler|erreur) [45]\d\d\b|\bhttp [45]\d\d\b",
        r"\b(?:in|under|down for|undergoing) (?:scheduled )?maintenance\b|\bbe back (?:soon|shortly|later|online)\b|\b(?:try|retry|reload\w*|refresh\w*|wait\w*)\b.*\b(?:again|later|minutes?|seconds?|page)\b",
        r"\b(?:query|request|connection|operation|lookup|upload|login)\b.*\b(?:failed|closed|refused|reset|lost|aborted|interrupted)\b|\bclosed the connection\b|\bno (?:content|response|data) was received\b",
        r"\bnicht (?:gefunden|verfugbar|erreichbar|gestattet|geladen|beantwortet|geantwortet)\b|\b(?:antwortet|hat)\b.*\bnicht\b.*\b(?:server|zeit\w*|rechtzeitig|geantwortet)\b|\b(?:server|dienst)\b.*\bnicht\b|\bverweigert\b|\bkeine berechtigung\b|\babgelaufen\b|\bdatenbankfehler\b|\bwartung\w*\b|\bfehlgeschlagen\b",
        r"\bintrouvable\b|\bn'existe pas\b|\bacces (?:refuse|interdit)\b|\bn'avez pas\b.*\b(?:droit|autorisation|permission|acces)\b|\bmis trop de temps\b|\bindisponible\b|\ba expire\b|\breessayez\b",
        r"\bno se (?:encontro|ha encontrado|pudo)\b|\bacceso (?:denegado|prohibido)\b|\bno tiene\b.*\b(?:permiso|autorizacion|acceso)\b|\bno respond\w+\b|\bno (?:esta )?disponible\b|\bha (?:caducado|expirado)\b|\bintentelo\b",
    ),
    "filler": (
        r"\b(?:to be (?:added|written|completed|supplied|determined|announced|continued|filled in|provided)|to follow|(?:coming|available) soon|(?:will|shall) (?:follow|be (?:added|written|completed|provided))|(?:goes|comes) here|under construction)\b",
        r"(?:\bnot|n't)(?: yet)? (?:been )?(?:yet )?(?:written|added|completed|filled in)\b|^(?:tbd|tba|tbc|todo)$",
        r"^(?:please )?(?:add|write|insert|put|give|enter|type|replace|provide|describe|fill in) (?:\w+ ){0,3}(?:text|content|section|details?|description|summary|paragraphs?|sentences?|information|introduction|overview|lead|heading|title|line)\b|\byour (?:text|content|title|heading)\b",
        r"\b(?:sample|dummy|placeholder|filler|example) (?:text|copy|content|paragraph|heading|sentence|title|caption|item|section|entry|image)\b",
        r"^(?:lead|opening|closing|first|second|third|fourth|last|next|untitled) (?:sentence|paragraph|heading|section|item|title)(?: (?:one|two|three|\w|\d+))?$",
        r"^(?:\w{0,10}text|inhalt|abschnitt|absatz|beschreibung|artikel|weiteres|details)\b.*\b(?:folgt|folgen|erganz\w+|ersetzen|einfugen|eingeben|geschrieben)\b|\b(?:hier|ihr|ihren)\b.*\btext\b|^(?:bitte )?diese[nrs]? (?:absatz|text|abschnitt|satz|zeile)\b.*\bersetzen\b|\b(?:platzhalter|blind|beispiel|muster)text\b|\b(?:abschnitt|artikel|text)\b.*\b(?:noch nicht|muss noch|wird noch|fehlt noch)\b|^(?:demnachst|kommt bald)$",
        r"\b(?:texte|contenu|section|article|paragraphe|partie)\b.*\b(?:a venir|a completer|a rediger|a ecrire|ici)\b|^(?:remplacez|inserez|ajoutez|redigez|completez)\b.*\b(?:texte|paragraphe|section|phrase|ligne|contenu|resume)\b|\btexte (?:factice|de remplissage|d'exemple)\b|\bn'a pas encore ete (?:redige|ecrit)\w*\b|^bientot disponible$",
        r"\b(?:texto|contenido|seccion|articulo|parrafo|apartado)\b.*\b(?:pendiente|por anadir|por escribir|proximamente|aqui)\b|^(?:reemplace|sustituya|escriba|introduzca|inserte|anada)\b.*\b(?:texto|parrafo|seccion|apartado|frase|linea|contenido|resumen)\b|\btexto de (?:relleno|ejemplo|muestra)\b|\b(?:aun|todavia) no se ha (?:escrito|redactado)\b|^proximamente$",
    ),
}
#: What speaks about a notice instead of being one.
_ABOUT = re.compile(r"\b(?:status code|means? that|known as|called|named|the (?:term|word|phrase|message|code|error) (?:is|was|for)|stands for|refers to|is (?:an?|the) \w+ (?:for|of|in|that|which)|(?:until|since|in|from|before|after|by) (?:1\d|20)\d\d|by the|bedeutet|genannt|signifie|appele\w*|significa|llamad[oa])\b")
#: Words notices are made of besides their core: of user interfaces, and common ones, by language.
VOCABULARY = {
    "interface": (
        "page pages site website web browser browsers app application content contents article articles revision revisions document version server wiki url address link"
        " file resource request requests requested database connection session system service servers cache node host gateway origin index origin upstream backend query code error errors"
        " ticket support team administrator admin user account login log sign code info message details http https ad blocker javascript script scripts js cookies time minute minutes"
        " second seconds moment section text sentence paragraph heading summary description subject point item example sample dummy copy title field list image caption"
        " information introduction overview lead space real view read show display displayed load loading loaded reload refresh run open opening continue render edit save saving saved replace"
        " reply answer rebuilt mode side technical placeholder blah bla zugriff up-to-date date modern current proper properly correctly latest"
    ),
    "en": (
        "a an and any are as at be been before below but by can cannot can't could do does don't else few for from had has have if in into is isn't it its it's just later may might more must my"
        " new no not nothing now of off on once one only oops or our out over please properly right should so some something soon sorry still such that the their then there these they this"
        " three to too two under unexpected until up us use using very was we we'll we're were when where which while will with works working work would yet you your yours again back happens"
        " currently temporarily unavailable after internal bad gateway forbidden best arrives short brief here written added needed try trying down fills looking about write"
    ),
    "de": (
        "aber alle als am an zurzeit derzeit ihrem platzhaltertext blindtext beispieltext mustertext auf aus bei bis bitte da damit das dass dem den der des die dies diese diesen dieser dieses diesem ein eine einen einer eines er es fur gewunschte haben hat hier"
        " ihr ihre ihren im in ist kann kein keine konnen lassen lasst mit nach neu nicht noch oder seite seiten server sich sie sind spater steht text um und uns versuchen erneut versuch vom von vor wartung"
        " was wird wurde wurden zu zum zur zeit artikel inhalt absatz abschnitt browser anzeigen anzuzeigen laden laedt ladt speichern fehler verwenden javascript skripte anfrage version antwort sehen lesen nutzen"
    ),
    "fr": (
        "a au aux avant avec ce ces cet cette dans de des droit du en est et etre ici il la l'article l'envoi l'erreur le les lire leur ne nous ou page par pas plus pour puis que qui sa se ses son sur un une"
        " veuillez votre vos vous y d'afficher afficher serveur site navigateur texte contenu paragraphe section recharger rechargez activez-les demandee demande temps repondre trop mis n'avez version"
        " cliquez essayer nouveau plus tard javascript scripts voir consulter consultation erreur requete"
    ),
    "es": (
        "a al antes aqui con de del donde el en es esta este esto favor han ha la las lo los mas no o para pagina por que recargue recargar se servidor sin sitio solicitada solicitado su sus tarde texto tiempo"
        " un una usted ver y habilitelos intente nuevo contenido navegador error version parrafo seccion vuelva guardar mostrar leer javascript scripts tiene"
    ),
}
#: Least share of a notice's words that its core and the vocabulary must hold, and the most words of a notice.
COVERED, LONGEST = 0.88, 40

_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS))
_AMBIGUOUS = re.compile("|".join(AMBIGUOUS))
_FIELD = re.compile("|".join(PLACEHOLDERS + AMBIGUOUS))
_KINDS = [(kind, re.compile("|".join(f"(?:{c})" for c in cores))) for kind, cores in CORES.items()]
#: The words of the cores themselves, and the beginnings of those given by their beginning.
_CORE_WORDS = re.findall(r"(?<![\\a-z'])([a-z][a-z']+)(\\w)?", " ".join(c for cores in CORES.values() for c in cores).replace(r"\b", " "))
_VOCABULARY = frozenset(w for words in VOCABULARY.values() for w in words.split()) | {w for w, more in _CORE_WORDS if not more}
_STEMS = tuple(w for w, more in _CORE_WORDS if more and len(w) > 3)
#: First words of log and status lines, and pieces of which other lines of that kind hold one.
_LOG_STARTS = frozenset("php fatal parse syntax uncaught runtime warning notice unhandled traceback exception http error errors fehler erreur could".split())
_LOG_PIECES = ("on line ", "refused", "<noscript", "<error", "error\":", "errors\":")
_NOTE_STARTS = frozenset("todo to fixme tbd".split())
_TAG = re.compile(r"</?(?:" + "|".join(t for t in TAGS if t not in ("NOSCRIPT", "ERROR")) + r")\b[^<>\n]*>", re.I)
_QUOTED = re.compile(r"''[^'\n]+''(?!')|“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"|‘[^’]*’")
_NAMED = re.compile(r"“[^”]{1,60}”|\"[^\"]{1,60}\"|«[^»]{1,60}»")
_LEET = str.maketrans("013457", "oieast")
_LEET_HINT = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")
_HEX = re.compile(r"[0-9a-fA-F]{6,}")
_LEET_WORD = re.compile(r"\b(?:[A-Za-z]+[0-9]|[0-9]+[A-Za-z])[A-Za-z0-9]*\b")
#: Words with a capital inside a passage, and numbers; link marks are gone, and a bold start is the subject's name.
_FRAMED = re.compile(r"(?:(?<=\S )|(?<=:))[A-ZÀ-ÖØ-Þ][\w'’-]*(?: \(?[A-ZÀ-ÖØ-Þ][\w'’)-]*)*|(?<!\w)\d+(?:[.,:/–-]\d+)*(?!\w)")
_SUBJECT = re.compile(r"^[^\w\n]*'''[^'\n]+'''", re.M)
_NOTE_TAG = re.compile(r"</?ref\b[^<>]*>", re.I)
_MASKS = re.compile(r"¤(?:[ ,]*¤)+")
_MASK = "¤"
#: A masked block needs so many words of its own, and as many of them as masks.
OWN_WORDS = 5
_EDGES = " '\"*.-–—:;([|!#=>_~"
_WORD = re.compile(r"(?<!\w)[a-z][a-z'-]*(?!\w)")
#: Literals of which every placeholder in other than square brackets holds one.
_LITERALS = ("{", "<%", "@@", "%", "#REF", "#VAL", "#DIV", "#NAM")
#: The same for ambiguous marks and words.
_MARKS = ("undefined", "NaN", "None", "null", "NULL", "nil", "XXX", "#", "__", "<", "{")
_QUOTES = ("\"", "“", "„", "«", "‘")
_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_PUNCTUATION = str.maketrans({c: " " for c in ".,;:!?()[]{}<>\"“”„«»‘’/|–—…=*#"})


def clean(text: str) -> str:
    """The text without code, comments, invisible characters and blanks written as entities."""
    if "<" in text:
        text = _CODE.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    return text.replace("\r\n", "\n") if "\r" in text else text


def blocks(text: str) -> list[str]:
    """Parts of a cleaned text between empty lines."""
    return _BLOCK.split(text)


def block_passages(block: str) -> list[str]:
    """The passages of one block, in order: its lines joined, but list, table and template lines by themselves."""
    out: list[str] = []
    held: list[str] = []
    for line in block.split("\n"):
        if _LINEWISE.match(line):
            if held:
                out += _SENTENCE.split(" ".join(" ".join(held).split()))
                held = []
            out += _SENTENCE.split(" ".join(line.split()))
        else:
            held.append(line)
    if held:
        out += _SENTENCE.split(" ".join(" ".join(held).split()))
    return [p for p in out if p]


def passages(text: str) -> list[str]:
    """The passages of one text, in order."""
    return [p for block in blocks(clean(text)) for p in block_passages(block)]


def fold(passage: str) -> str:
    """Lower case without accents, tags, markup at the edges, or digits that stand for letters."""
    return fold_all([passage])[0]


def fold_all(passages: list[str]) -> list[str]:
    """The passages of a block, folded together."""
    if not passages:
        return []
    text = "\n".join(passages)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "''" in text:
        text = text.replace("'''", "").replace("''", "")
    if _LEET_HINT.search(text):
        text = _LEET_WORD.sub(lambda m: m[0] if _HEX.fullmatch(m[0]) else m[0].translate(_LEET), text)
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", text.replace("’", "'")))
    lines = text.lower().split("\n")
    if "  " in text:
        lines = [" ".join(line.split()) for line in lines]
    return [line.strip(_EDGES) for line in lines]


def masked(frames: list[str]) -> str | None:
    """The frames of one block's passages together; None if too little besides masks is left."""
    text = " ".join(frames)
    words, masks = text.count(" ") + 1, text.count(_MASK)
    return text if words - masks >= max(OWN_WORDS, masks) else None


def quotes(passage: str) -> list[str]:
    """What stands in quotation marks or italics."""
    if "''" not in passage and not any([q in passage for q in _QUOTES]):
        return []
    return _QUOTED.findall(passage.replace("'''", ""))


def suspected(passage: str) -> bool:
    """Whether an ambiguous mark or word for no value occurs outside of quotation marks and italics.

    A term that the passage also shows in quotation marks or italics is spoken about, not left over.
    """
    if not any([m in passage for m in _MARKS]) or not _AMBIGUOUS.search(passage):
        return False
    shown = {m[0] for quote in quotes(passage) for m in _AMBIGUOUS.finditer(quote)}
    return any(m[0] not in shown for m in _AMBIGUOUS.finditer(passage))


def frames(parts: list[str]) -> list[str]:
    """The folded parts of a block with everything masked that fills a field: placeholders, ambiguous marks, names and numbers."""
    if not parts:
        return []
    text = "\n".join(parts)
    if "'''" in text:
        text = _SUBJECT.sub(_MASK, text)
    if bracketed(text) or any([x in text for x in _LITERALS]) or any([m in text for m in _MARKS]):
        text = _FIELD.sub(_MASK, text)
    if "[[" in text or "'''" in text:
        text = text.replace("[[", "").replace("]]", "").replace("'''", "")
    return fold_all(_MASKS.sub(_MASK, _FRAMED.sub(_MASK, text)).split("\n"))


def telling(frame: str) -> bool:
    """Whether a frame has a mask and something besides that tells what belongs there (a word, or the cells of a table)."""
    return _MASK in frame and ("||" in frame or bool(_WORD.search(frame)))


def bracketed(passage: str) -> bool:
    """Whether something stands in single square brackets."""
    return "[" in passage and "[" in passage.replace("[[", "")


def parts(passage: str) -> list[str]:
    """The passage as it stands, or its running text and its reference notes apart: a note has fields of its own."""
    return [p for p in _NOTE_TAG.split(passage) if p.strip()] if "<ref" in passage else [passage]


def block_kind(block: list[str], kinds: list[str | None]) -> str | None:
    """The kind of a block of which rules recognise at least half of the words (unfilled fields do not count)."""
    sizes: dict[str, int] = {}
    for passage, kind in zip(block, kinds, strict=True):
        if kind and kind not in UNFILLED:
            sizes[kind] = sizes.get(kind, 0) + passage.count(" ") + 1
    if 2 * sum(sizes.values()) < sum([p.count(" ") + 1 for p in block]):
        return None
    return max(sorted(sizes), key=sizes.__getitem__, default=None)


def trusted(passage: str, folded: str) -> str | None:
    """The kind of residue a passage certainly is, or None. A notice in quotation marks or italics is spoken about."""
    return trusted_all([passage], [folded])[0]


def trusted_all(passages: list[str], folded: list[str]) -> list[str | None]:
    """The kinds of the passages of a block."""
    if not passages:
        return []
    text = "\n".join(passages)
    fields = (bracketed(text) or any([x in text for x in _LITERALS])) and bool(_PLACEHOLDER.search(text))
    lines = "\n".join(folded).translate(_PUNCTUATION).split("\n")
    return [
        "placeholder" if fields and _PLACEHOLDER.search(passage) else _spoken(passage, plain, line.split())
        for passage, plain, line in zip(passages, folded, lines, strict=True)
    ]


def _spoken(passage: str, folded: str, words: list[str]) -> str | None:
    """The kind of a passage by its words."""
    if not words:
        return None
    if (words[0] in _LOG_STARTS or words[0].isdigit() or any([x in folded for x in _LOG_PIECES])) and _LOG.search(folded):
        return "error"
    if words[0] in _NOTE_STARTS or len(words) > 2 and words[0] == words[1] == words[2]:
        if _NOTE.search(folded):
            return "filler"
    if not FILLER_WORDS.isdisjoint(words):
        known = FILLER_WORDS.intersection(words)
        if len(known) >= 3 and 5 * sum([w in known for w in words]) >= 2 * len(words):
            return "filler"
    # Running text is told by its own words first, before any pattern is tried.
    if len(words) <= LONGEST and 2 * sum(map(_VOCABULARY.__contains__, words)) >= len(words) and covered(folded):
        for kind, cores in _KINDS:
            if cores.search(folded) and not _ABOUT.search(folded) and not any([cores.search(fold(q)) for q in quotes(passage)]):
                return kind
    return None


def holding_filler(folded: list[str]) -> list[bool]:
    """Which passages of a block have two words or more of the public filler text."""
    text = "\n".join(folded).translate(_PUNCTUATION)
    if FILLER_WORDS.isdisjoint(text.split()):
        return [False] * len(folded)
    return [len(FILLER_WORDS.intersection(line.split())) >= 2 for line in text.split("\n")]


def covered(folded: str) -> bool:
    """Whether the words of a passage are mostly of cores and vocabulary (numbers, single letters and a quoted name do not count)."""
    words = _WORD.findall(_NAMED.sub(" ", folded))
    foreign = sum([len(w) > 1 and w not in _VOCABULARY and not w.startswith(_STEMS) for w in words])
    return foreign <= (1 - COVERED) * len(words)


def explains(passage: str) -> bool:
    """Whether the passage shows something in quotation marks or italics: likeness alone never labels such a passage."""
    return bool(quotes(passage))
