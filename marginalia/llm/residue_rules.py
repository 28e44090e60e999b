"""Which lines of a text are residue, which are frame, and which are content of its own."""

from __future__ import annotations

import re

# The forms of an unfilled slot.
SLOT = re.compile(
    r"\{\{[^{}|\n]{0,60}\}\}|\$\{[^{}\n:]{1,60}\}|\{%[=-]?[^{}%\n]{1,60}%\}|<%=?[^<>%\n]{1,60}%>|<[A-Za-z][A-Za-z -]{0,40} here>|<(?:insert|your|enter|add|fill in)\b[^<>\n]{0,40}>|@@\w[\w -]{0,40}@@"
    r"|#\[[^\[\]\n]{1,40}\]#|%[A-Z][A-Z_]{1,40}%|(?<!\[)\[[A-Z][A-Z _-]{2,40}\](?![\](])|(?<![A-Za-z_])__[a-z][a-z_]{0,40}?__(?![A-Za-z_])|(?<![\w.])[Xx]{4,}(?!\w)|\.{6,}|_{5,}|\[\s*(?:\.\.\.|…)\s*\]"
)
# The words of the common filler text.
LATIN = frozenset(
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cum cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu ex excepteur "
    "exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui quis reprehenderit sed "
    "sint sit sunt tempor ullamco ut vel velit veniam voluptate".split()
)
# Frequent short words of the corpus' languages that Latin doesn't have; a sentence of theirs hardly does without.
FUNCTION = frozenset(
    "the a an of to and or is are was were be been by for from with on at as it its this that these those not no but if when then than which who has have had can will may must should would into over after before "
    "le la les un une des du de d l au aux ce cette ces il elle on nous vous ils que qu dans par pour sur avec sans pas ne n plus a été sont ont fait se s son sa ses leur ou mais donc quand "
    "der die das den dem ein eine einen einem einer und oder ist sind war waren wird werden wurde nicht kein keine mit von vom zu zum zur auf für aus bei nach vor über im am als auch wenn dass sich hat haben "
    "el los las una unos unas del al y o en con por para sin no lo su sus se ha han fue fueron son era como más pero cuando".split()
)
ENDING = re.compile(r".*(?:[aiou]|[aeiou][mr]|[iu]s|[aei]n?t|unt)")
PLAIN = re.compile(r"[A-Za-z .,;:!?]+")
# What a text of its own refers to: a note, a ticket, a name in code.
OWN = re.compile(r"\[\[[^\[\]\n]+\]\]|\b[A-Z]{2,8}-\d{2,}\b|\b[A-Za-z]+(?:_[a-z]+)+\b|`[^`\n]+`")
OWN_WORDS, OWN_SENTENCES = 6, 3
# What is typed on a keyboard to fill a field.
TYPED = frozenset("aaa abc asdf bar baz bla blah bbb dummy foo foobar hjkl jkl qux qwer qwerty qwertz sdf test testing tests wxyz xxx xyz xxxx yyy zxcv zzz".split())
# Reason phrases of HTTP, the three-digit codes are matched by number.
REASONS = (
    "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request timeout|conflict|gone|length required|"
    "precondition failed|payload too large|content too large|uri too long|unsupported media type|range not satisfiable|expectation failed|misdirected request|unprocessable (?:entity|content)|"
    "locked|failed dependency|too early|upgrade required|precondition required|too many requests|request header fields too large|unavailable for legal reasons|internal server error|"
    "not implemented|bad gateway|service unavailable|gateway time-?out|http version not supported|insufficient storage|loop detected|network authentication required"
)
_hex = r"[0-9a-f]{6,40}"
# Messages of errors, refusals and missing access, filler sentences, and notices about scripts, cookies or browsers,
# in the languages of the corpus. Each pattern must match a whole sentence.
MESSAGES = [
    # errors with a status
    rf"(?:http(?:/\d(?:\.\d)?)?|error|erreur|fehler|status|code)?[ :]*[45]\d\d[ :,(-]*(?:{REASONS})\)?(?: - .{{0,60}})?",
    rf"(?:http(?:/\d(?:\.\d)?)?|error|erreur|fehler|status|code)[ :]*[45]\d\d",
    rf"(?:{REASONS})(?: - .{{0,60}})?",
    rf"status=[45]\d\d(?: \w+=(?:\"[^\"]*\"|\S+))*",
    r"\{ ?\"?(?:error|errors|status|code|message|detail)\"? ?:.*\}",
    r"(?:error|erreur|fehler) [45]\d\d ?: [^.!?]{3,60}",
    rf"(?:reference|référence|referenz|referencia|request id|trace id|incident|ray id) ?:? ?#?{_hex}",
    r"/\S+ could not be (?:served|found|loaded|displayed|reached)",
    r"[a-z][a-z-]*/\d+(?:\.\d+)+",
    rf"(?:traceback|stack trace|backtrace)(?: .{{0,20}})?(?: {_hex}| \(most recent call last\))?:?", r"\w*(?:error|exception|warning)(?: \d+)?: .{0,100}", r"(?:no|empty) (?:content|data|results?|response|body)(?: .{0,20})?", r"at [\w.$]+\(.*\)", r"file \"[^\"]*\", line \d+.*",
    # errors in words
    r"the (?:page|document|file|note|space|resource) you (?:asked|are looking|were looking|requested)(?: for)? (?:could not be found|does not exist|was not found|has moved|is not available)",
    r"(?:page|document|file) not found", r"go back to the (?:home|start|previous) ?page",
    r"(?:something|an error|an unexpected error) (?:went wrong|has occurred|occurred)(?: .{0,60})?", r"(?:please )?(?:try|retry) again(?: later)?", r"please (?:try again|reload|retry)(?: .{0,30})?",
    r"(?:access|permission) denied", r"you do(?: not|n't) have (?:the )?(?:permission|rights?|access)(?: .{0,60})?", r"you (?:are|do) not (?:allowed|authorized|authorised|have access)(?: .{0,60})?",
    r"your session (?:has expired|expired|timed out)(?: .{0,60})?", r"(?:please )?(?:sign|log) in(?: again)?(?: to (?:continue|view|read).{0,40})?",
    r"too many requests", r"slow down and retry later", r"(?:the )?(?:service|server|site) (?:is )?(?:temporarily )?(?:unavailable|overloaded|down for maintenance|not available)(?: .{0,40})?",
    r"this (?:export|page|document|space|note|file) is empty(?: because .{0,80})?", r"this (?:page|document|space|content|note) (?:is no longer available|no longer exists|has been (?:removed|deleted|moved))(?: .{0,60})?",
    r"(?:i'?m|i am|we are|we're) (?:very |really )?sorry,? but (?:i|we) (?:can(?:not|'t)|am unable to|are unable to) .{0,120}", r"(?:i|we) (?:can(?:not|'t)|am unable to|are unable to) (?:help|assist|comply|fulfil|fulfill|answer|provide|process) .{0,120}", r"as an (?:ai|assistant|automated)\b.{0,120}",
    r"la page (?:demandée|que vous (?:cherchez|demandez)) (?:n'existe (?:pas|plus)|est introuvable)(?: .{0,50})?", r"page introuvable", r"accès (?:refusé|interdit)", r"vous n'avez pas (?:les droits|le droit|accès|l'autorisation)(?: .{0,50})?",
    r"une erreur (?:interne |inattendue )?(?:est survenue|s'est produite)(?: .{0,50})?", r"(?:veuillez )?réessay(?:ez|er)(?: plus tard| ultérieurement)?", rf"\(?réf\.? ?:? ?{_hex}\)?", r"votre session a expiré(?:,? .{0,50})?", r"(?:veuillez vous )?reconnecte[zr](?:-vous)?(?: .{0,40})?",
    r"(?:le )?service (?:est )?(?:momentanément |temporairement )?indisponible(?: .{0,40})?", r"trop de requêtes(?: .{0,40})?", r"(?:désolé|nous sommes désolés),? .{0,100}",
    r"seite nicht gefunden", r"die (?:angeforderte |gewünschte )?seite (?:wurde nicht gefunden|existiert nicht(?: mehr)?|ist nicht verfügbar)(?: .{0,50})?", r"zugriff (?:verweigert|nicht erlaubt)", r"sie haben keine (?:berechtigung|rechte|zugriffsrechte)(?: .{0,60})?",
    rf"(?:ein )?interner (?:server)?fehler(?:,? kennung {_hex})?", r"ein fehler ist aufgetreten(?: .{0,50})?", r"(?:bitte )?(?:versuchen sie es )?(?:später )?(?:erneut|noch einmal|nochmals)(?: später)?(?: erneut)? ?(?:versuchen)?", r"ihre sitzung ist abgelaufen(?:[,.]? .{0,60})?", r"(?:bitte )?(?:melden sie sich )?(?:erneut|wieder) an(?:melden)?",
    r"(?:der )?dienst (?:ist )?(?:vorübergehend |derzeit |zurzeit )?nicht (?:verfügbar|erreichbar)", r"zu viele anfragen(?: .{0,40})?",
    r"página no encontrada", r"la página (?:solicitada|que busca) no (?:existe|se encuentra)(?: .{0,50})?", r"acceso (?:denegado|prohibido)", r"(?:usted )?no tiene (?:permiso|permisos|acceso)(?: .{0,60})?", rf"se ha producido un error(?: interno)?(?: ?\({_hex}\))?(?: .{{0,50}})?", r"(?:por favor,? )?(?:inténtelo|vuelva a intentarlo)(?: de nuevo)?(?: más tarde)?", r"(?:su|la) sesión ha (?:caducado|expirado)(?:,? .{0,50})?",
    r"(?:el )?servicio (?:temporalmente )?no (?:está )?disponible(?: temporalmente)?(?: .{0,40})?", r"servicio no disponible", r"demasiadas (?:solicitudes|peticiones)(?: .{0,40})?",
    # filler
    r"(?:sample|example|placeholder|dummy) (?:heading|title|text|paragraph|content|caption|subtitle)(?: goes here)?(?:,? (?:please )?(?:replace|remove|change) .{0,50})?", r"(?:text|content|description|summary|details?|more) (?:to come|coming soon|goes here|to follow)(?: .{0,20})?", r"coming soon", r"under construction", r"tb[dc]", r"todo", r"n/?a",
    r"(?:insert|add|enter|type|put|place) (?:your|some|the) (?:own )?(?:text|title|content|description|name|heading|paragraph)(?: .{0,30})?", r"write (?:a|your) (?:short |brief )?(?:description|summary|text|paragraph|introduction)(?: .{0,40})?", r"this is (?:a|an|some) (?:sample|example|placeholder|dummy|test)(?: .{0,40})?", r"replace (?:this|me|before publishing)(?: .{0,40})?", r"click (?:here )?to (?:edit|add)(?: .{0,40})?",
    r"texte (?:à venir|provisoire|d'exemple|ici)(?:,? .{0,40})?", r"paragraphe (?:provisoire|d'exemple)(?:,? .{0,50})?", r"(?:titre|contenu) (?:à venir|provisoire|d'exemple)", r"(?:insérez|saisissez|écrivez) (?:votre|le|un|une) (?:texte|titre|description|contenu)(?: .{0,30})?", r"à (?:compléter|remplir|remplacer avant publication)",
    r"(?:text|inhalt|beschreibung) folgt(?: in kürze)?", r"platzhaltertext(?:,? .{0,50})?", r"(?:beispiel|muster|platzhalter)(?:text|titel|absatz|überschrift)(?:,? .{0,50})?", r"(?:hier )?(?:fügen sie )?(?:ihren|den) text (?:hier )?(?:einfügen|ein|eingeben)", r"hier steht (?:ihr|der|ein) .{0,30}", r"in (?:arbeit|bearbeitung)",
    r"texto (?:pendiente|provisional|de ejemplo|de relleno)(?:,? .{0,40})?", r"párrafo (?:provisional|de ejemplo)(?:,? .{0,50})?", r"(?:título|contenido) (?:pendiente|provisional|de ejemplo)", r"(?:inserte|escriba|introduzca) (?:su|el|un|una) (?:texto|título|descripción|contenido)(?: .{0,30})?", r"(?:por completar|en construcción)",
    # scripts, cookies, browsers
    r"(?:please )?(?:enable|turn on|activate|allow|accept) (?:java ?script|scripts?|cookies?|it|them)(?: .{0,60})?", r"java ?script (?:is|must be|needs to be) (?:required|disabled|enabled|turned off|needed)(?: .{0,60})?", r"(?:this|the) (?:tool|page|viewer|site|app|application|content|document|note|space) (?:needs?|requires?|stays empty|works only|does not work|uses|cannot) .{0,80}",
    r"(?:your|this) browser (?:does not|doesn't|is not|isn't|must|is too|is out) .{0,80}", r"you need (?:to enable |to allow )?(?:java ?script|cookies|scripts|(?:a|another) (?:newer |modern |different )?browser)(?: .{0,60})?", r"(?:please )?(?:enable|turn) (?:it|them) on(?: .{0,40})?", r"(?:please )?enable it and reload", r"(?:please )?(?:use|install|switch to|update) (?:another|a (?:newer|modern|different|supported)|your) browser(?: .{0,40})?", r"we (?:look at|are checking|check) your browser(?: first)?(?:,? .{0,40})?", r"one moment(?:,? please)?", r"checking your browser(?: .{0,40})?",
    r"loading", r"please wait", r"(?:we use|this site uses) cookies(?: .{0,80})?",
    r"(?:veuillez )?(?:activez|activer|autorisez|autoriser|acceptez|accepter) (?:java ?script|les scripts|les cookies)(?: .{0,60})?", r"votre navigateur (?:n'exécute|ne|n'est|doit|est trop) .{0,80}", r"(?:ce|cet|cette) (?:contenu|page|document|outil|site|note) (?:nécessite|a besoin|requiert|ne s'affiche|utilise) .{0,60}", r"java ?script est (?:requis|désactivé|nécessaire)(?: .{0,60})?", r"chargement(?: en cours)?", r"(?:veuillez )?(?:patienter|utiliser un autre navigateur)(?: .{0,30})?",
    r"(?:bitte )?(?:aktivieren|erlauben|akzeptieren) sie (?:bitte )?(?:java ?script|skripte|cookies)(?:,? .{0,60})?", r"(?:dieser|diese|dieses) (?:inhalt|seite|dokument|werkzeug|notiz) (?:benötigt|braucht|erfordert|verwendet|bleibt leer) .{0,60}", r"ihr browser (?:unterstützt|führt|ist|muss) .{0,80}", r"java ?script (?:ist|wird|muss) .{0,60}", r"wird geladen", r"(?:bitte )?(?:warten|einen anderen browser)(?: .{0,40})?",
    r"(?:por favor,? )?(?:active|habilite|permita|acepte) (?:java ?script|los scripts|las cookies|cookies)(?: .{0,60})?", r"(?:este|esta) (?:contenido|página|documento|herramienta|nota) (?:necesita|requiere|utiliza|usa) .{0,60}", r"su navegador (?:no|debe|es) .{0,80}", r"java ?script (?:es|está|debe) .{0,60}", r"cargando", r"(?:por favor,? )?espere(?: .{0,30})?",
]
WORDS = re.compile(r"[^\W\d_]+")
VALUE = re.compile(r"\b[0-9a-f]{8,}\b|\d+")
MESSAGE = re.compile("|".join(f"(?:{m})" for m in MESSAGES), re.I)
TAGS = re.compile(r"</?(?:html|head|title|body|h[1-6]|p|div|span|noscript|center|hr|br|main|section|article|b|strong|em|i|meta|script|link|ul|li|pre|code)\b[^<>\n]*/?>|<!doctype[^>]*>|<!--.*?-->", re.I | re.S)
FRONT = re.compile(r"\A\s*---[ \t]*\n(?:[^\n]*\n){0,40}?---[ \t]*(?:\n|\Z)")
FENCED = re.compile(r"^ {0,3}(```+|~~~+)[^\n]*$", re.M)
FRAME = re.compile(
    r"menu|menü|menú|navigation|"
    r"(?:[^\W\d_][\w' -]{0,20}(?: ?[|·»>/•] ?)){1,8}[^\W\d_][\w' -]{0,20}|"  # a row of links
    r"(?:page|seite|página|p\.) ?\d+(?: ?(?:/|of|de|von|sur) ?\d+)?|"
    r"-+ ?(?:end of (?:page|document|file)|fin (?:de page|du document)|ende(?: der seite)?|fin de página) ?-+|"
    r"(?:exported|printed|generated|exporté|exportiert|exportado|imprimé|last (?:updated|modified))(?: (?:on|at|le|am|el|by))?:? ?[\d:./T -]{4,25}|"
    r"[a-z][a-z-]{2,20} v?\d+(?:\.\d+){1,3}|"  # the tool that made the page
    r"(?:©|\(c\)|copyright) ?.{0,60}|[-=*_#|:+. …]+",
    re.I,
)
REFERENCE = re.compile(rf"\(? ?\b(?:réf|ref|request id|trace id|incident|kennung)\.? ?:? ?#?{_hex} ?\)?", re.I)
SENTENCE = re.compile(r"(?<=[.!?…])(?:\s+|(?=\())|\n+")


MARK = "¤"
# A text without any of these has no slot; they cost far less than looking for slots themselves.
_SIGNS = ("{{", "${", "{%", "<%", " here>", "@@", "#[", "__", "......", "...]", "…")
_SIGN = re.compile(r"%[A-Z][A-Z_]|\[[A-Z][A-Z _-]{2}|\[\s*(?:\.\.\.|…)|<(?:insert|your|enter|add|fill in)|XXX|xxx|Xxx")


def units(text: str) -> tuple[list[str], bool]:
    """The lines that aren't frame or title, slots replaced by ``MARK``, and whether there is fenced code."""
    text = text.replace(MARK, " ").replace("\r\n", "\n").replace("\r", "\n")
    if text.lstrip()[:3] == "---":
        text = FRONT.sub("", text, count=1)
    code = ("```" in text or "~~~" in text) and bool(FENCED.search(text))
    if any(x in text for x in _SIGNS) or _SIGN.search(text):
        text = SLOT.sub(MARK, text)
    if "<" in text:
        text = TAGS.sub("\n", text)
    out = []
    for i, line in enumerate(text.strip().split("\n")):
        line = line.strip()
        if not line or (i == 0 and line[0] == "#" and MARK not in line) or FRAME.fullmatch(line):
            continue
        out.append(line)
    return out, code


def _bare(sentence: str) -> str:
    return sentence.strip().strip("*_ ").rstrip(".!?…:, ").lstrip("¡¿")


def _filler(line: str, words: list[str]) -> bool:
    return bool(words) and (len(words) >= 4 and sum(w in LATIN for w in words) >= 0.85 * len(words) or all(w in TYPED for w in words) or invented(line, words))


def _own(lines: list[str], message: re.Pattern) -> bool:
    """Whether there are ``OWN_SENTENCES`` different sentences with references of their own."""
    own: set[str] = set()
    for line in lines:
        if MARK in line or not any(x in line for x in "-_`[") or not OWN.search(line):
            continue
        said = [s for s in SENTENCE.split(line) if s and s not in own and any(x in s for x in "-_`[") and OWN.search(s) and len(s.split()) >= OWN_WORDS and not message.fullmatch(_bare(s))]
        if said and not _filler(line, [w.lower() for w in WORDS.findall(line)]):
            own.update(said)
            if len(own) >= OWN_SENTENCES:
                return True
    return False


LABEL = re.compile(r"(?:#{1,6} |\*\*|[-*+] )?[^\W\d_](?:[^\W\d_]|['’ -]){0,28}(?:\*\*)? ?[:,]?")
ROW = re.compile(r"\|(?: ?[^\W\d_](?:[^\W\d_]|[' -]){0,24} ?\|)+")


def invented(line: str, words: list[str]) -> bool:
    """Filler in no language: six words or more, plain letters, not one function word, and most of the
    longer words end as in Latin; of a line of twelve words, where a missing function word says more, two fifths."""
    if len(words) < 6 or not PLAIN.fullmatch(line) or not FUNCTION.isdisjoint(words):
        return False
    longer = [w for w in words if len(w) > 3]
    return len(longer) >= 3 and sum(ENDING.fullmatch(w) is not None for w in longer) >= (0.6 if len(words) < 12 else 0.4) * len(longer)


def kind(text: str, message: re.Pattern = MESSAGE) -> tuple[str, str]:
    """``residue`` (nothing but residue and frame), ``content`` (at least ``OWN_SENTENCES`` different sentences of
    ``OWN_WORDS`` words or more, each with a reference of its own, none a message), or ``unknown`` (all else, fenced code too); and
    the whole text in a normal form in which fills of one template agree. ``message`` matches whole sentences that are messages."""
    lines, code = units(text)
    own = _own(lines, message)
    residue = unfilled = 0
    content = code or own  # code is no residue by rule
    normal = []
    for line in lines:
        slots = line.count(MARK)
        words = [w.lower() for w in WORDS.findall(line)]
        if slots:
            if len(words) <= max(4, 3 * slots + 1):
                residue += 1
            else:
                content = True
            normal.append(line.lower())
            continue
        if _filler(line, words):
            residue += 1
            normal.append("filler")
            continue
        normal.append(VALUE.sub("0", line.lower()))
        if content:
            continue  # no residue by rule any more; what is left is the normal form
        label, colon, value = line.partition(":")
        if message.fullmatch(line.rstrip(".!?…:, ")) or (colon and LABEL.fullmatch(label) and message.fullmatch(value.strip(" .!?…"))):
            residue += 1
            continue
        if ROW.fullmatch(line):
            continue
        for s in SENTENCE.split(REFERENCE.sub(" ", line)):
            s = (s or "").strip().strip("*_ ")
            bare = s.rstrip(".!?…:, ").lstrip("¡¿")
            if not bare:
                continue
            if message.fullmatch(bare) or message.fullmatch(s):
                residue += 1
            elif LABEL.fullmatch(s) and len(words) <= 3:
                unfilled += s.endswith(":") or s.startswith("#")
            else:
                content = True
    return ("content" if own else "residue" if (residue or unfilled > 2) and not content else "unknown"), "\n".join(normal)
