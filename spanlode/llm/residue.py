"""Template residue, filler, error pages and script notices.

A text is reduced to the lines of its own prose: code blocks, code in back-ticks, quoted lines and mark-up go. Lines
are normalised and counted per host; a line that a large share of a host's texts have is that host's boilerplate and
is subtracted. A text is named if a line that is left is evidence:

* it has a slot of a template language or form that nobody filled;
* it repeats itself, or is the usual Latin;
* it has the form of a run-time's error output or of an HTTP status with its standard phrase and little else;
* every sentence of it speaks the language of errors, notices or filler and nothing else: a sentence counts for a
  kind if it holds a word of both of the kind's roles (something that fails and what failing it does; something that
  is needed and what to do about it; a stand-in and what becomes of it) and at most a fifth of its words, or one,
  are outside the vocabulary. A line that discusses or quotes such things has other words around them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlode.plans.runtime import written

BOILERPLATE_SHARE = 0.2
Z = 2.576  # of the 99 % confidence interval of a share
UNKNOWN_SHARE = 0.2

#: Slots of common template languages and forms.
SLOTS = (
    r"\{\{\{?[-~#/&>]?\s*[A-Za-z_][\w.]*(?:\s*\|\s*\w+(?:\s*:\s*(?:'[^'{}]*'|\"[^\"{}]*\"|\w+))?)*\s*[-~]?\}?\}\}",
    r"\{%-?\s*[A-Za-z_][\w. ]*-?%\}",
    r"<%[=-]?\s*[\w.@]+\s*-?%>",
    r"<\?=?\s*\$\w+\s*;?\s*\?>",
    r"\[%\s*[a-z_][\w.]*\s*%\]",
    r"\$\{[A-Za-z_][\w.]*\}",
    r"#\{[a-z_][\w.]*\}",
    r"\{![A-Za-z_][\w.]*\}",
    r"\*\|[A-Z][A-Z0-9_:]*\|\*",
    r"@@\w+@@",
    r"%%[A-Za-z_][\w ]*%%",
    r"<<\s*[A-Za-z][\w -]*\s*>>",
    r"\[\[[a-z]+(?:_[a-z]+)+\]\]",
    r"%\([a-z_]+\)[sdif]",
    r"%[A-Z]+(?:_[A-Z]+)+%",
    r"\b__[A-Z]+(?:_[A-Z]+)+__\b",
    r"\bYOUR_[A-Z]+(?:_[A-Z]+)*\b",
    r"\bTODO\([a-z_ ]+\)",
    r"\[(?:INSERT|Insert|insert|ENTER|Enter|YOUR|Your|your) [A-Za-z _-]+\]",
    r"<[A-Z]+(?: [A-Z]+)* (?:GOES )?HERE>",
    r"<(?:your|insert|enter)[-_ ][a-z_ -]+>",
    r"<[a-z]+(?:_[a-z]+)+>",
    r"(?<![\w$#%{(=])\{[a-z]+(?:_[a-z]+)+\}(?!\})",
    r"(?<![\w!\]])\[[A-Z][a-z]+(?: [A-Z][a-z]+)+\](?![(\[:])",
)

#: Words of the usual Latin filler.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()

#: Lines that repeat themselves, lower case; marks to do and no more.
REPEATED = (
    rf"(?:(?:{'|'.join(LATIN)})\b[\s.,;!?]*){{4,}}",
    r"(\w{1,12})(?:[\s,.]+\1\b){5,}[\s.]*",
    r"(\w{1,12} \w{1,12})(?:[\s,.]+\1\b){2,}(?: \w+)?[\s.]*",
    r"(?:todo|tbd|tba|fixme)[.:! ]*",
)

#: Forms of run-time error output, lower case, numbers as 0.
OUTPUT = (
    r"traceback \(most recent call last\):?",
    r"file \"[^\"]+\", line 0, in \S+",
    r"[a-z_][\w.]*(?:error|exception): .{1,80}|[a-z_][\w.]*(?:error|exception):?",
    r"exception in thread .{1,80}|at [\w.$]+\([\w.]+(?::0)?\)",
    r"\{ ?\"(?:error|errors|status|code)\" ?: ?[{\[\"0].{0,200}",
    r"(?:fatal|uncaught|unhandled)(?: \w+)? error\b.{0,80}",
)

#: Phrases of HTTP status codes of failure.
PHRASES = (
    "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request time-?out|conflict|gone|length required|precondition failed|"
    "(?:payload|content|request entity) too large|(?:uri|request-uri) too long|unsupported media type|expectation failed|misdirected request|unprocessable (?:entity|content)|locked|upgrade required|"
    "too many requests|unavailable for legal reasons|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|http version not supported|insufficient storage|access denied"
)
#: A status code as 0 and its phrase, with a few words of the kind that servers add.
STATUS = rf"(?:(?:http|https|error|status|code)\b[ /.:0]*)*(?:\b0[ :-]+(?:{PHRASES})|(?:{PHRASES})[ :-]+\(?(?:error |code )*0\b\)?)[.!]?(?:[ -]*[a-z]+[/ ]0(?:[. ]0)*)?|(?:http |server )?(?:error|fehler|erreur|errore|erro) 0[.!]?"

#: Of each kind, what it is about and what it says about it, in six languages. Words may be in both.
ABOUT = {
    "error": """page pages site website webpage server servers service connection request resource url address link host gateway network internet database application app response certificate proxy dns
      permission access something problem issue system file files preview image video document data http https nginx apache cloudflare security domain error errors exception traffic maintenance
      seite webseite dienst verbindung anfrage zugriff adresse datenbank netzwerk fehler serverfehler berechtigung
      site serveur connexion requête ressource adresse accès erreur problème réseau autorisation
      página sitio servidor servicio conexión solicitud recurso dirección acceso red permiso problema
      serviço conexão pedido endereço acesso rede permissão pagina sito servizio connessione richiesta indirizzo accesso rete""",
    "notice": """javascript java js script scripts scripting cookie cookies browser browsers human robot captcha rate limit quota requests request seconds minutes moment moments
      browser minuten sekunden javascripts navigateur sécurité secondes instant navegador segundos momento secondi""",
    "session": """session sign log login signin account sitzung anmeldung konto session connexion compte sesión cuenta sessão conta sessione account""",
    "filler": """text something copy content contents paragraph paragraphs placeholder dummy sample filler body description details words draft blindtext platzhaltertext platzhalter inhalt texte contenu texto contenido conteúdo testo""",
}
SAYS = {
    "error": """found unavailable unreachable reached reach failed failure fail refused denied forbidden unauthorized invalid timeout timed down offline overloaded interrupted reset closed broken gone missing moved exist exists removed
      wrong cannot can't couldn't unable unexpected internal fatal oops whoops error errors exception establishing permission don't impossible puede acceder acessar
      gefunden verfügbar erreichbar verweigert fehlgeschlagen abgelehnt interner unerwarteter existiert unterbrochen
      introuvable trouvée trouvé indisponible refusé interne inattendue échoué échec existe interrompue
      encontrada encontrado disponible denegado fallado interno inesperado rechazada
      indisponível negado falhou interno trovata trovato disponibile negato fallita errore erro""",
    "notice": """enable enabled activate turn allow accept require required requires need needs must disabled disable blocked supported supports verify verifying checking check wait exceeded reached again continue without
      weiter aktivieren aktiviert einschalten erforderlich benötigt deaktiviert warten erneut überprüft
      continuer activer autoriser activé désactivé requis nécessaire patienter attendre vérification
      continuar activar activa habilite habilitar necesario requiere desactivado espere nuevo
      ative ativar habilitar necessário aguarde novamente attiva attivare abilita necessario attendere nuovo""",
    "session": """expired timed again continue abgelaufen erneut weiter expiré expirée reconnecter continuer expirado expirada caducado vuelva nuevo inicie continuar expirou novamente scaduta nuovo""",
    "filler": """placeholder dummy sample filler replace replaced here goes coming soon later draft supplied platzhalter added provided written defined tbd write insert add put enter your own something follows example
      ersetzen später bald folgt hier blindtext platzhaltertext
      remplacer remplissage ici venir relleno ejemplo aquí reemplazar substituir exemplo aqui sostituire esempio""",
}
#: Further words that such sentences are made of.
PLAIN = """a an the this that these those it its it's is are was were be been being am to of in on at for from by with and or but if you your yours you're we we're we'll our us i my me do does did done have has had can could may might will would should not no
  please sorry apologies apologize apologise try trying retry again back soon shortly later now then next before after while until when out up off over all any some more too many much there here go went going see view read open visit refresh reload return start use using used
  currently temporarily permanently down contact administrator admin support team owner help home homepage check correct spelling id reference ray incident code status number trace requested request asked looking look looks like available
  side end thing few moment minutes seconds time days day performing scheduled upgrade updating working work works run runs running order full functionality experience experiencing technical difficulties inconvenience settings using version modern current instead valid
  sign in signed just one only about today active carry undergoing display load loading se working worked section chapter block area viewer arrived received sent get getting make made sure
  bitte sie der die das den dem ein eine einen und oder ist sind nicht kein keine um zu es wird wurde werden wurden in im auf für von mit ihr ihre ihren ihrem diese dieser dieses später versuchen noch einmal entschuldigung leider melden an weiter fortfahren sehen anzeigen steht kennung zum zur thema
  veuillez le la les un une des de du et ou est sont pas ne pour que vous votre vos nous notre cette ce ces à au aux en dans sur avec plus tard réessayer désolé désolée désolés continuer afficher voir demandée demandé recherchez avant publication publier
  por favor lo los las el un una unos y o es son no para que usted su sus este esta estos a al en con más tarde intente intentarlo sentimos continuar ver mostrar solicitada solicitado busca antes sustituir publicar
  o os as um uma e ou é são não para que você seu sua este esta ao em com mais tente continuar ver mostrar il lo gli un uno una e o è sono non per che questo questa su con più riprova continuare vedere""".split()

#: Words of sentences that tell of such lines and are none.
TELLING = "message messages logged handler handlers handling test tests returns returned shows showed prints raises".split()

#: The same in scripts without spaces between words, and in Cyrillic.
UNSPACED = {
    "error": r"(?:ページ|サイト|サーバー|アクセス|接続|リクエスト).{0,12}(?:見つかりません|存在しません|できません|拒否|エラー|利用できません)|(?:页面|網頁|网页|服务器|伺服器|访问|連線|连接).{0,8}(?:不存在|找不到|无法|無法|错误|錯誤|被拒绝|失败)|(?:找不到|无法访问|無法存取).{0,8}(?:页面|網頁|网页|网站|網站)|страница не найдена|сервер недоступен|доступ запрещ[её]н|페이지를 찾을 수 없습니다",
    "notice": r"(?:javascript|スクリプト|クッキー|cookie|ブラウザ).{0,12}(?:有効|必要|無効|オン)|(?:请|請).{0,4}(?:启用|啟用|开启|打开).{0,8}(?:javascript|cookie|脚本)|しばらくお待ちください|(?:再度|もう一度)ログイン|(?:请稍候|請稍候|请重新登录|請重新登入)|(?:включите|разрешите) (?:javascript|cookies?|куки)|(?:자바스크립트|javascript).{0,8}(?:활성화|사용)",
    "filler": r"(?:ダミー|サンプル)テキスト|ここに(?:テキスト|文章|本文)を.{0,6}(?:入力|挿入)|(?:此处|在此)(?:输入|填写)(?:文字|内容|文本)|占位(?:符|文字|文本)|текст[- ]заполнитель",
}

#: Names of mark-up that ends a line.
TAGS = "html|head|body|title|h[1-6]|p|div|span|br|hr|center|section|article|main|header|footer|nav|ul|ol|li|pre|table|tr|td|th|strong|em|b|i|a|noscript|img"



def prose_lines(text: Column) -> Column:
    """The lines of the text's own prose, in order, without blank ones."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?s)(?m:^)[ \t]*(```+|~~~+).*?(?:\n[ \t]*\1[`~]*[ \t]*(?=\n|$)|$)", "\n")
    t = F.regexp_replace(t, r"(`+)[^\n]*?[^`]\1(?!`)", "`")
    t = F.regexp_replace(t, rf"(?i)</?(?:{TAGS})(?:\s[^<>]*)?/?>", "\n")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith(">"))


def normal_line(line: Column) -> Column:
    """Lower case, numbers as 0, single spaces, without list marks, heading marks and emphasis around it."""
    x = F.regexp_replace(F.lower(line), r"^(?:[-*+•]\s+|#{1,6}\s+|\d+[.)]\s+)?[*_]*|[*_]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\d+", "0"), r"\s+", " "))


def _any(patterns) -> str:
    """One pattern for a whole line; back-references in the single patterns count on from the groups before them."""
    out, before = [], 0
    for p in patterns:
        out.append(re.sub(r"\\(\d)", lambda m, n=before: f"\\{int(m[1]) + n}", p))
        before += re.compile(p).groups
    return f"^(?:{'|'.join(out)})$"


SLOT, REPEATED_LINE, OUTPUT_LINE = r"(?=[{<\[$#*@%_YT])(?:" + "|".join(SLOTS) + ")", _any(REPEATED), _any((*OUTPUT, STATUS))
#: What every slot has; a fast test before the full one.
SLOT_START = r"[{%\[<]|@@|\*\||__|YOUR_|TODO\("
_ABOUT, _SAYS = {k: v.split() for k, v in ABOUT.items()}, {k: v.split() for k, v in SAYS.items()}
_KNOWN = sorted({*PLAIN, *(w for t in (_ABOUT, _SAYS) for v in t.values() for w in v)})
_MARKS = ".,;:!?…()[]|/–—-。！？"
_SENTENCE = r"[.!?…:;]+(?=\s|$)|[。！？]+|\s[-–—]\s"
_QUOTES = '["“”„«»‘`]'


def _sentence_kind(sentence: Column) -> Column:
    """1 error, 2 notice, 3 filler, 4 nothing but the vocabulary of these, 0 anything else; null for no words."""
    words = F.filter(F.split(sentence, r"[^\p{L}\p{Nd}']+"), lambda w: (w != "") & ~w.rlike(r"\d"))
    known = lambda names: (lambda w: w.isin(names))

    def judged(w: Column) -> Column:
        strange = F.size(F.filter(w, lambda x: ~x.isin(_KNOWN)))
        holds = lambda k: F.exists(w, known(_ABOUT[k])) & F.exists(w, known(_SAYS[k])) & (F.size(F.filter(w, lambda x: x.isin(sorted({*_ABOUT[k], *_SAYS[k]})))) >= 2)
        kind = F.when(holds("notice") | holds("session"), 2).when(holds("error"), 1).when(holds("filler"), 3).otherwise(4)
        return F.when(F.size(w) == 0, F.lit(4)).when((strange <= F.greatest((F.size(w) > 2).cast("int"), F.floor(F.size(w) * UNKNOWN_SHARE))) & ~F.exists(w, known(TELLING)), kind).otherwise(0)

    return F.when(F.trim(sentence).rlike(f"^(?=.* |forbidden|unauthorized)(?:{PHRASES})$"), 1).otherwise(F.transform(F.array(words), judged)[0])


def _may_speak(normal: Column) -> Column:
    """Whether so few words are outside the vocabulary that every sentence may count: a fast test before sentences are
    looked at. Marks end sentences at most once each, and a sentence may have one strange word, or a fifth."""
    plain = F.translate(normal, _MARKS + "’", " " * len(_MARKS) + "'")
    marks = F.length(normal) - F.length(F.translate(normal, _MARKS, ""))

    def few(w: Column) -> Column:
        return F.size(F.filter(w, lambda x: ~x.isin(["", *_KNOWN]) & ~x.contains("0"))) <= 1 + marks + F.size(w) * UNKNOWN_SHARE

    return F.transform(F.array(F.split(plain, " ")), few)[0]


def _spoken(normal: Column) -> Column:
    plain = F.regexp_replace(F.replace(normal, F.lit("’"), F.lit("'")), r"\b(?:could|can) ?not\b", "cannot")
    kinds = F.transform(F.filter(F.split(plain, _SENTENCE), lambda x: F.trim(x) != ""), _sentence_kind)
    return F.transform(F.array(kinds), lambda ks: F.when(~F.exists(ks, lambda k: k == 0), F.get(F.filter(ks, lambda k: k < 4), F.lit(0))))[0]


def line_evidence(line: Column, normal: Column) -> Column:
    """``slot``, ``filler``, ``error`` or ``notice``; null for other lines. The kind of a line of several sentences is
    that of the first that has one."""
    told = F.get(F.array(F.lit(None).cast("string"), F.lit("error"), F.lit("notice"), F.lit("filler")), F.coalesce(_spoken(normal), F.lit(0)))
    return F.coalesce(
        F.when(line.rlike(SLOT_START) & line.rlike(SLOT), "slot").when(normal.rlike(REPEATED_LINE), "filler").when(normal.rlike(OUTPUT_LINE), "error"),
        F.when(_may_speak(normal) & ~normal.rlike(_QUOTES), told),
        F.when(F.octet_length(normal) > F.length(normal), F.when(normal.rlike(UNSPACED["error"]), "error").when(normal.rlike(UNSPACED["notice"]), "notice").when(normal.rlike(UNSPACED["filler"]), "filler")),
    )


def told_lines(texts: DataFrame) -> DataFrame:
    """(id, host, h, kind): every normalised line of every text by its hash, with the evidence it is or null.

    ``texts`` has id, host and text. Lines, patterns and words are looked at within the row, in the JVM; nothing is
    exchanged."""
    both = F.transform(prose_lines(F.col("text")), lambda x: F.struct(x.alias("line"), normal_line(x).alias("normal")))
    told = F.transform(both, lambda s: F.struct(F.xxhash64(s["normal"]).alias("h"), line_evidence(s["line"], s["normal"]).alias("kind")))  # nested, so that each pattern runs once a line
    rows = texts.where(F.col("text").isNotNull()).select("id", F.coalesce("host", F.lit("")).alias("host"), F.explode(told).alias("s"))
    return rows.select("id", "host", "s.*")


def boilerplate(lines: DataFrame, texts: DataFrame, share: float = BOILERPLATE_SHARE) -> DataFrame:
    """(host, h): lines that recur in a host's texts: the lower end of the confidence interval (Wilson's) of the share
    of texts that have the line is at least ``share``. The one line of a lone text does not recur; in two texts of two
    it does. A line of a hot host is one row a task before it is exchanged; rows are told apart by id."""
    counts = lines.select("id", "host", "h").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where("n > 1")
    hosts = texts.where(F.col("text").isNotNull()).select("id", F.coalesce("host", F.lit("")).alias("host")).distinct().groupBy("host").agg(F.count("*").alias("texts"))
    n, p = F.col("texts"), F.col("n") / F.col("texts")
    low = (p + Z * Z / (2 * n) - Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    return counts.join(hosts, "host").where(low >= share).select("host", "h")


def residue(texts: DataFrame, share: float = BOILERPLATE_SHARE) -> DataFrame:
    """(id, kind, lines): texts with evidence left after boilerplate is subtracted, once per kind.

    ``texts`` has id, host and text. All lines of all texts are counted by host; what recurs is subtracted, and what is
    left is evidence or not. Texts are read and cut once: the lines' hashes and kinds are written as a table that the
    counts and the rest are then taken from. A null host is a host of its own; null, empty and blank texts are never
    named; repeated rows are counted once.
    """
    lines = written(told_lines(texts))
    left = lines.where(F.col("kind").isNotNull()).distinct().join(boilerplate(lines, texts, share), ["host", "h"], "left_anti")
    return left.groupBy("id", "kind").agg(F.count("*").alias("lines"))


def line_counts(texts: DataFrame) -> DataFrame:
    """(host, normal, texts): how many of a host's texts have each normalised line."""
    rows = texts.where(F.col("text").isNotNull()).select(F.coalesce("host", F.lit("")).alias("host"), F.explode(F.array_distinct(F.transform(prose_lines(F.col("text")), normal_line))).alias("normal"))
    return rows.groupBy("host", "normal").agg(F.count("*").alias("texts"))
