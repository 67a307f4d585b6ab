"""Template residue, filler, error messages and notices that stand where a page's content should be.

All patterns run as JVM regular expressions over title and text; no row leaves the JVM and nothing is shuffled. Slots are
recognised by a grammar per delimiter. What surrounds them discounts them: fenced, quoted and listed code, requests and routes,
sentences that talk about templates or say how to write a slot. Messages only count as whole lines, and by density: on a page
with much prose, a line that reads like one is part of what the page says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that name a slot when they stand alone in brackets or signs that are also used in ordinary text.
SLOT_WORDS = (
    "name", "names", "title", "titles", "email", "mail", "phone", "fax", "office", "room", "unit", "department", "faculty", "school", "biography",
    "bio", "role", "position", "heading", "summary", "photo", "picture", "caption", "address", "url", "link", "date", "year", "content", "body",
    "description", "profile", "person", "staff", "member", "user", "author", "subject", "category", "company", "organisation", "organization",
)
_WORD = r"[\p{L}][\p{L}\p{N}]*"
_NAME = rf"{_WORD}(?:[ ._-]{_WORD}){{0,3}}"
_PARTED = rf"{_WORD}(?:[._]{_WORD}){{1,3}}"
_KNOWN = rf"(?:{'|'.join(SLOT_WORDS)})"
_KNOWN_NAME = rf"(?:{_KNOWN}(?:[ ._-]{_WORD}){{0,2}}|(?:{_WORD}[ ._-]){{1,2}}{_KNOWN})"

#: The grammar of unfilled slots, one alternative per delimiter.
SLOT_GRAMMAR = {
    "double or triple braces": rf"\{{\{{\{{?\s*{_NAME}(?:\s*\|[^{{}}\n]*)?\s*\}}\}}\}}?",
    "statement": rf"\{{%-?\s*{_NAME}[^{{}}\n]{{0,60}}%\}}",
    "dollar brace": rf"\$\{{\s*{_NAME}\s*\}}",
    "hash brace": rf"#\{{\s*{_NAME}\s*\}}",
    "brace": rf"(?<![\{{$#\\])\{{\$?\s*(?:{_NAME}|\d{{1,2}})\s*\}}(?!\}})",
    "double brackets": rf"\[\[\s*{_NAME}\s*\]\]",
    "bracket": rf"(?<!\[)\[(?:{_KNOWN_NAME}|{_PARTED}|(?:your|insert|add|enter|type|put|write)\s[^\]\n]{{1,40}})\](?!\])",
    "angle": rf"<(?:{_KNOWN_NAME}|{_PARTED}|name of [^<>\n]{{1,30}}|(?:your|insert|add|enter)\s[^<>\n]{{1,40}})>",
    "server tag": r"<(?:%[=@-]?|\?(?:=|php\b)?)[^<>\n]{1,80}[%?]>",
    "percent": rf"(?<![\w%])%%?(?:{_KNOWN_NAME}|{_PARTED}|[A-Z]{{4,}})%%?(?![\w%])",
    "underscores": rf"(?<!\w)__{_WORD}(?:[ ._]{_WORD}){{0,3}}?__(?!\w)",
    "hashes": rf"##\s?{_NAME}\s?##",
    "at signs": rf"@@\s?{_NAME}\s?@@",
    "exclamation marks": rf"!!{_NAME}!!",
    "double parentheses": rf"\(\((?:{_KNOWN_NAME}|{_PARTED})\)\)",
    "dollars": rf"(?<![\w$])\$(?:{_KNOWN_NAME}|{_PARTED})\$(?![\w$])",
    "colon": rf"(?<![\w:/]):{_WORD}_{_WORD}\b",
    "object": r"\[object \w+\]",
    "failed value": r"\bNaN [\p{L}]+|\bnull null\b|\bundefined undefined\b|(?m:^(?:null|undefined|NaN|None)$)",
}
SLOT = "(?i:" + "|".join(p for k, p in SLOT_GRAMMAR.items() if k not in ("percent", "failed value")) + ")|" + SLOT_GRAMMAR["failed value"] + "|(?i:" + SLOT_GRAMMAR["percent"].replace("|[A-Z]{4,}", "") + r")|(?<![\w%])%%?[A-Z]{4,}%%?(?![\w%])"

# Words of sentences that talk about templates and code rather than being left over from them.
_TALK_WORDS = (
    r"syntax\w*|template\w*|expansions?|placeholders?|macros?|tutorials?|shell scripts?|mark-?up|variables? (?:names?|expansion)|null pointers?|undefined behaviou?r|"
    r"programming|source code|regular expressions?|(?:explains?|describes?|shows?|teach(?:es)?|learns?) (?:how|to)|syntaxe|gabarits?|plantillas?|sintaxis|Vorlagen?(?:sprache)?|шаблон\w*|синтаксис\w*|模板|语法|テンプレート|構文"
)
TALK = rf"(?i)(?:(?<=[.!?。！？…»”\"] )|(?m:^))(?!\s*(?:{SLOT})\s*:)[^.!?。！？\n]*?(?:{_TALK_WORDS})(?:[^.!?。！？\n]|[.!?](?=[^\s]))*"

# Dummy copy. Lines made of these words, and lines that ask to be replaced.
LATIN_FILLER = (
    "lorem", "ipsum", "dolor", "amet", "sit", "consectetur", "adipiscing", "elit", "sed", "eiusmod", "tempor", "incididunt", "labore", "magna", "aliqua",
    "fermat", "nunc", "ligula", "massa", "felis", "orci", "risus", "quisque", "eget", "odio", "luctus", "varius", "semper", "nulla", "porta", "vitae", "pellis",
    "vestibulum", "mauris", "vivamus", "praesent", "donec", "etiam", "aenean", "cras", "duis", "fusce", "integer", "morbi", "nam", "nullam", "pellentesque",
    "phasellus", "proin", "sagittis", "suspendisse", "ullamcorper", "ut", "enim", "minim", "veniam", "quis", "et", "in", "ac", "at", "non", "id", "vel",
)
# Lines of a code listing: nothing but slots and signs, or code punctuation. A listing is a run of such lines below a line that
# talks about templates or code (one is enough after a colon), or three lines with code punctuation in a row.
_SLOT_LINE = rf"[^\S\n]*(?:{SLOT})(?:{SLOT}|[^\S\n]|[\p{{P}}\p{{S}}])*+"
_CODE_LINE = r"(?:(?=[^\n]*[=(){}<>])[^\n]*;|[^\n]*[^{\n]\{(?!\{)|[^\S\n]*\}[;,)]*|[^\S\n]*(?:<[a-zA-Z][^<>\n]*>[^\n]*)?</\w+>|[^\S\n]*(?://|#!)[^\n]*)[^\S\n]*"
_LISTED = rf"(?:(?:{_SLOT_LINE}|{_CODE_LINE}|[^\S\n]*(?=\n))(?:\n|\z))"
LISTING = (
    rf"(?im)(^[^\n]*(?:{_TALK_WORDS})[^\n]*[:：][^\S\n]*\n){_LISTED}++"
    rf"|(^[^\n]*(?:{_TALK_WORDS.replace('programming|', '')})[^\n]*\n)(?:[^\S\n]*\n)*+{_LISTED}{{2,}}+"
    rf"|(?:^{_SLOT_LINE}\n)*+(?:^{_CODE_LINE}(?:\n|\z)){{3,}}+{_LISTED}*+"
)

# Code within a line: fenced blocks, back quotes, string literals after an f, a bracket, a comma or an equals sign, requests; and slots that a
# sentence says how to write.
CODE_SPANS = (
    r"(?s:```.*?(?:```|\z))|`[^`\n]+`|(?:\b[fFrRbB]{1,2}|[(=,\[]\s*)(?:\"[^\"\n]*\"|'[^'\n]*')|\b(?:GET|POST|PUT|PATCH|DELETE|HEAD)\s+/\S*"
    rf"|(?i:\b(?:use|uses|using|write|writes|writing|type|typing|such as|e\.g\.|called|prints?|renders?|yields?|means|expressions?|tags?|tokens?|markers?|slots?|routes?|endpoints?|parameters?)\s+)(?:{SLOT})(?=[\s,;.]+\p{{Ll}}|[.,;])[^.!?。！？\n]*"
)

#: The words of the standard copies that hardly occur elsewhere, and those that are also ordinary words of some language.
FILLER_ONLY = (
    "lorem", "ipsum", "amet", "consectetur", "consectetuer", "consetetur", "adipiscing", "adipisicing", "sadipscing", "elitr", "eiusmod", "eirmod", "tempor", "incididunt", "invidunt", "labore", "aliqua", "aliquyam",
    "veniam", "nostrud", "exercitation", "ullamco", "laboris", "aliquip", "commodo", "consequat", "irure", "reprehenderit", "voluptate", "velit", "cillum", "fugiat", "pariatur", "excepteur", "occaecat", "cupidatat",
    "proident", "mollit", "laborum", "deserunt", "nonumy", "voluptua", "accusam", "rebum", "clita", "kasd", "gubergren", "takimata", "sanctus", "nibh", "euismod", "tincidunt", "laoreet", "aliquam", "volutpat", "wisi", "tation", "lobortis",
    "vestibulum", "mauris", "vivamus", "praesent", "aenean", "fusce", "morbi", "pellentesque", "phasellus", "proin", "sagittis", "suspendisse", "ullamcorper", "vulputate", "molestie", "feugiat", "dignissim", "faucibus", "tristique", "curabitur", "malesuada",
)
_ALSO_FILLER = (
    *LATIN_FILLER, "do", "dolore", "dolores", "ad", "nisi", "ex", "ea", "aute", "esse", "eu", "sint", "non", "sunt", "culpa", "qui", "officia", "anim", "est", "diam", "erat", "justo", "duo", "vero", "eos", "accusam", "stet", "no", "sea",
    "ligula", "a", "nec", "cum", "sociis", "natoque", "penatibus", "magnis", "dis", "parturient", "montes", "nascetur", "ridiculus", "mus", "libero", "leo", "metus", "urna", "tellus", "lacus", "quam", "ante", "arcu", "enim", "pede", "dui", "iriure", "hendrerit",
    "vel", "illum", "facilisis", "eros", "et", "accumsan", "iusto", "odio", "blandit", "luptatum", "zzril", "delenit", "augue", "duis", "te", "facilisi", "suscipit", "nisl", "autem", "eum",
)
FILLER_WORD = rf"\b(?:{'|'.join(sorted({*FILLER_ONLY, *_ALSO_FILLER}))})\b"
FILLER_ONLY_WORD = rf"\b(?:{'|'.join(sorted(FILLER_ONLY))})\b"
#: A line or sentence is filler with so many words of the copies, so many of the rare ones, and this share of all its words.
FILLER_LEAST, FILLER_ONLY_LEAST, FILLER_SHARE = 4, 2, 0.6
_FILLER_LINES = (
    rf"(?:(?:{'|'.join(LATIN_FILLER)})[\s.,;]+){{4,}}(?:{'|'.join(LATIN_FILLER)})?[.,;]?",
    r"(?:x{3,}|test|mustertext|пример текста|示例文字|占位文字|サンプルテキスト|ダミーテキスト|texto de ejemplo|sample text)(?:[\s.,]*(?:x{3,}|test|mustertext|пример текста|示例文字|占位文字|サンプルテキスト|ダミーテキスト|sample text))+",
    r"サンプルテキスト|ダミーテキスト|texto de (?:ejemplo|relleno|prueba)|sample text|dummy text|blindtext|platzhalter(?:text)?|faux texte|texte d'exemple|текст-заполнитель|рыба-текст",
    r"(?:your|the) (?:text|title|headline|content|biography|description|name)(?: here)? goes here|(?:text|title|headline|content|heading|caption|image|photo) (?:goes )?here|(?:caption|image|photo|text|title|content) placeholder",
    r"(?:insert|enter|add|type|write|put|paste) (?:a |an |the |your |some )?(?:[\p{L}]+ ){0,4}(?:here|of the (?:person|page|unit)|biography|description|text|title)(?: here)?",
    r"(?:this is )?(?:a )?(?:sample|dummy|example|placeholder) (?:copy|text|content)(?:[;,]? please (?:replace|change|edit|remove).*)?|please replace this text",
    r"example person(?:, example [\p{L}]+)*|(?:example|sample) (?:name|title|room|person)(?:, (?:example|sample) [\p{L}]+)*",
    r"(?:todo|tbd|fixme|to do)\b:?(?: [\p{L}]+){0,5}",
    r"(?:hier (?:steht|kommt|folgt) (?:ein |der |das )?(?:blind|platzhalter|beispiel|muster)?text|(?:bitte )?(?:hier )?(?:text|titel|überschrift|name|beschreibung|biografie)(?: bitte)?(?: hier)? (?:einfügen|eingeben|ergänzen|eintragen)|bitte text einfügen)",
    r"(?:insérer|insérez|saisir|saisissez|écrire|ajouter|ajoutez) (?:ici )?(?:la |le |votre |un |une )?[\p{L}]+(?: ici)?|(?:texte|titre|contenu) à (?:remplacer|compléter)|faux texte de mise en page|(?:votre )?(?:texte|titre) ici",
    r"(?:escriba|escribe|inserte|introduzca|añada|ponga) (?:aquí )?(?:el |la |su |un |una )?[\p{L}]+(?: aquí)?|(?:título|texto|contenido) (?:provisional|de relleno|provisional de relleno|de ejemplo)|(?:su )?(?:texto|título) aquí",
    r"(?:здесь (?:будет|должен быть|появится)|вставьте|введите|добавьте|впишите)(?: [\p{L}]+){1,3}|(?:ваш )?(?:текст|заголовок) здесь",
    r"(?:请|此处|在此|这里)(?:输入|填写|添加|插入)[\p{IsHan}]{1,8}|(?:此处|这里)(?:是|为)?(?:示例|占位)[\p{IsHan}]{0,6}",
    r"(?:ここに)?[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]{1,10}を(?:入力|記入|挿入)してください|ここに[\p{IsHan}]{1,6}が入ります",
)
_CODE = r"(?:reference|error|ref\.?|incident|request) (?:no\.?|number|id|code)?:? ?[\w-]*\d[\w-]*|(?:code|código|kennung|référence|код|编号|代码|コード|受付番号) ?:?\s?[\d-]+"
# Messages of servers and applications, as whole lines.
_ERROR_LINES = (
    r"(?:http|status|error|erreur|fehler|código de error|ошибка|错误|エラー)[\s:]*[1-5]\d\d(?:\b.{0,40})?|[45]\d\d[\s:–-]+(?:[\p{L}-]+ ?){1,4}|error 500.*",
    r"(?:page|file|document|resource) not found|not found|bad gateway|gateway time-?out|forbidden|unauthori[sz]ed|internal (?:server )?error|service (?:temporarily )?unavailable|access (?:is )?denied|permission denied|an? (?:unexpected |unknown )?error (?:has )?occurred.*",
    r"(?:sorry, )?(?:the|this|that) (?:page|profile|file|document|link|address|resource|url|record|person)\b.{0,40}(?:could not be found|cannot be found|can't be found|was not found|not found|does not exist|doesn't exist|no longer exists?|is no longer available|has (?:been )?(?:moved|removed|deleted)|is broken).{0,30}",
    r"(?:the )?(?:service|server|site|website|system|database) is (?:currently |temporarily )?(?:unavailable|down|offline|overloaded|not available).{0,30}",
    r"access to (?:this|the) [\p{L} ]{1,30} (?:is|was|has been) (?:denied|forbidden|restricted)|you (?:do not|don't) have (?:permission|access|the rights?).{0,50}|you are not (?:authori[sz]ed|allowed).{0,50}",
    r"your (?:session|login) (?:has )?(?:expired|timed out).{0,40}|too many requests.{0,40}|something went wrong.{0,40}|(?:please )?try again later|please (?:try|come) (?:again|back) (?:later|in a few minutes|soon)",
    r"the (?:upstream|origin|remote|web)? ?(?:host|server|gateway) (?:did not (?:answer|respond)|is not responding|took too long|returned an error).{0,40}|(?:the )?(?:connection|query|request) (?:to|of) the [\p{L} ]{1,40} (?:failed|timed out|was refused)|(?:could not|cannot|unable to) (?:connect|load|open|find|reach)\b.{0,60}|database (?:connection )?error.{0,40}",
    r"(?:we are (?:currently )?carrying out|(?:down|closed|offline|unavailable) for|under|undergoing) (?:scheduled |planned )?maintenance.{0,30}|scheduled maintenance.{0,30}",
    r"(?:(?:php )?(?:fatal |parse |catchable fatal )?error|warning|notice|deprecated): .{0,120}(?: on line \d+|:\d+|uncaught .*)|traceback \(most recent call last\).*|uncaught (?:exception|[\p{L}]*error).*|exception in thread .*|[\w.]+(?:exception|error): .{0,120}|(?:mysql|sql|ora-\d+|sqlstate).{0,20}error.{0,60}|stack trace:?.*|at [\w.$]+\([\w.]+:\d+\)",
    r"seite (?:wurde )?nicht gefunden|die (?:angeforderte )?(?:seite|datei)\b.{0,30}(?:existiert nicht|nicht gefunden|wurde (?:verschoben|gelöscht|entfernt)).{0,20}|(?:interner )?serverfehler|zugriff verweigert|(?:der|dieser) dienst ist .{0,30}(?:nicht erreichbar|nicht verfügbar)|(?:wegen )?wartungsarbeiten.{0,30}|ihre sitzung ist abgelaufen|keine berechtigung.{0,40}|ein fehler ist aufgetreten.{0,30}|bitte versuchen sie es (?:später|erneut).{0,20}",
    r"page (?:introuvable|non trouvée)|la page (?:demandée )?(?:n['’]existe (?:pas|plus)|est introuvable|a été (?:déplacée|supprimée)).{0,30}|accès (?:refusé|interdit)|erreur (?:interne )?(?:du )?serveur|service (?:momentanément |temporairement )?indisponible|(?:site en |en )?maintenance en cours|en maintenance|votre session a expiré|une erreur (?:est survenue|s['’]est produite).{0,30}|(?:veuillez )?réessayer plus tard",
    r"p[áa]gina no encontrada|la p[áa]gina (?:solicitada )?(?:no existe|no se ha encontrado|ha sido (?:movida|eliminada)).{0,30}|acceso denegado|error (?:interno )?del servidor|servicio (?:temporalmente )?no disponible|(?:sitio )?en mantenimiento|su sesi[óo]n ha (?:caducado|expirado)|se ha producido un error.{0,30}|int[ée]ntelo m[áa]s tarde",
    r"(?:запрошенная )?страница (?:не (?:найдена|существует)|удалена|перемещена|удалена или перемещена)|доступ (?:запрещ[её]н|закрыт)|(?:внутренняя )?ошибка сервера|(?:сервис|сайт|служба) (?:временно )?недоступ(?:ен|на)|ведутся (?:технические|профилактические) работы|(?:ваша )?сессия истекла|произошла ошибка.{0,30}|попробуйте (?:ещё раз )?позже",
    r"(?:您访问的)?(?:页面|网页)(?:不存在|未找到|已删除|已删除或更名|已失效|无法访问)|找不到(?:该)?(?:页面|网页|文件)|(?:没有访问权限|拒绝访问|禁止访问|无权访问)|(?:服务器)?内部错误|服务器(?:内部)?错误|(?:服务|系统)(?:暂时|暂)?不可用|(?:系统|网站)维护中.{0,10}|会话已过期|请稍后(?:再试|重试)|出错了",
    r"(?:お探しの)?ページ(?:が見つかりません(?:でした)?|は移動または削除されました|は存在しません|が存在しません)|アクセスが拒否されました|アクセスできません|(?:内部)?サーバー?エラー|(?:現在|ただいま)?(?:サービスは|サービスを)?(?:一時的に)?(?:利用できません|ご利用いただけません)|ただいまメンテナンス中です|メンテナンス中.{0,10}|セッションの有効期限が切れました|しばらくしてから.{0,20}|エラーが発生しました",
)
# Notices that demand scripts or a check of the browser, as whole lines.
_NOTICE_LINES = (
    r"(?:you need to |please |you must )?(?:enable|activate|turn on|switch on|allow) (?:javascript|scripts?)\b.{0,80}|(?:this|the) (?:app|application|page|site|website|directory|service|list)\b.{0,30}(?:requires?|needs?) (?:javascript|scripts?).{0,40}|your browser (?:does not|doesn't) (?:run|support|allow|execute) (?:javascript|scripts?).{0,80}|(?:javascript|scripts?) (?:is|are|must be) (?:required|disabled|turned off|enabled).{0,60}",
    r"(?:checking|verifying) your browser.{0,60}|just a moment.{0,60}|verify(?:ing)? (?:that )?you are (?:a )?human.{0,40}|please (?:complete|solve) the (?:security check|captcha).{0,40}|loading|please wait",
    r"(?:bitte )?(?:aktivieren|schalten) sie (?:javascript|skripte).{0,60}|(?:diese|die|dieses) (?:anwendung|seite|verzeichnis|webseite)\b.{0,20}(?:benötigt|erfordert|braucht) (?:javascript|skripte)|ihr browser wird (?:geprüft|überprüft)|wird geladen|javascript (?:ist|wird) (?:erforderlich|benötigt|deaktiviert)",
    r"(?:veuillez )?(?:activer|activez) (?:javascript|les scripts).{0,60}|javascript est (?:nécessaire|requis|désactivé).{0,40}|vérification de votre navigateur|(?:cette|ce) (?:application|page|site)\b.{0,20}(?:nécessite|requiert) (?:javascript|les scripts)|chargement(?: en cours)?",
    r"(?:active|habilite|activar|debe activar|por favor,? active) (?:javascript|los scripts).{0,60}|(?:esta|este|el) (?:aplicación|página|sitio|directorio)\b.{0,20}(?:necesita|requiere) (?:javascript|scripts)|comprobando su navegador|javascript es necesario|cargando",
    r"(?:включите|разрешите) (?:javascript|скрипты).{0,60}|для работы (?:сайта|страницы|приложения) (?:нужен|требуется|необходим) javascript|проверяем ваш браузер|идёт загрузка|загрузка",
    r"请(?:启用|开启|打开)(?:javascript|脚本).{0,20}|本(?:页面|网站|站)需要(?:javascript|脚本)(?:支持)?|正在(?:检查|验证|检测)(?:您的)?浏览器|(?:正在)?加载中?",
    r"javascriptを有効にしてください|(?:この|当)(?:ページ|サイト)(?:は|には)(?:javascript|スクリプト)が必要です|ブラウザ(?:ー)?を確認(?:しています|中です?)|読み込み中(?:です)?",
)
# Titles that an editor or server gives to a page nobody named.
_DEFAULT_TITLES = (
    r"untitled(?: (?:document|page))?(?: ?\(?\d+\)?)?|(?:new|blank|empty|sample|test|default) (?:page|document|title)(?: ?\((?:copy|\d+)\))?|(?:page|document) title|title|document ?\d*|page ?\d+|copy of .{0,30}|no title|index of /.*|welcome to nginx!?|apache2? .*default page.*|it works!?|home ?page ?\d*",
    r"unbenannt(?:es dokument|e seite)?|ohne titel|neue seite(?: \(kopie\))?|sans titre|document sans (?:titre|nom)|nouvelle page(?: \(copie\))?|sin t[íi]tulo|documento sin t[íi]tulo|(?:p[áa]gina nueva|nueva p[áa]gina)(?: \(copia\))?|без (?:названия|имени)|новая страница(?: \(копия\))?|无标题(?:文档|页面|页)?|未命名(?:文档|页面)?|新(?:建)?页面(?:（副本）|\(副本\))?|無題(?:の(?:ドキュメント|ページ))?|(?:新しい|新規)ページ(?:（コピー）|\(コピー\))?|error",
)


def _whole_line(patterns: tuple[str, ...]) -> str:
    return rf"(?ium)^[\s\p{{Zs}}]*(?:{'|'.join(patterns)})[\s\p{{Zs}}]*[.!…。！:;]*[\s\p{{Zs}}]*$"


FILLER, ERRORS, NOTICES = (_whole_line(p) for p in (_FILLER_LINES, _ERROR_LINES, _NOTICE_LINES))
REFERENCE = _whole_line((_CODE,))


def slots_left(text: Column) -> Column:
    """True where a slot is left unfilled, outside code listings and sentences that talk about templates or code."""
    prose = F.regexp_replace(F.regexp_replace(text, CODE_SPANS, " "), LISTING, "$1$2\n")
    return text.rlike(SLOT) & F.regexp_replace(prose, TALK, " ").rlike(SLOT)


def has_filler(text: Column) -> Column:
    """True where a whole line is filler, or where most words of a line or sentence are those of dummy copy."""
    count = lambda s, p: F.regexp_count(s, F.lit(p))
    words, known, only = (lambda s, p=p: count(s, p) for p in (r"[\p{L}\p{M}]+", f"(?iU){FILLER_WORD}", f"(?iU){FILLER_ONLY_WORD}"))
    dense = lambda s: (only(s) >= FILLER_ONLY_LEAST) & (known(s) >= FILLER_LEAST) & (known(s) >= FILLER_SHARE * words(s))
    parts = F.concat(F.split(text, r"\n"), F.split(text, r"\n|(?<=[.!?。！？…])\s+"))
    return text.rlike(FILLER) | (text.rlike(f"(?i){FILLER_ONLY_WORD}") & F.exists(parts, dense))


#: A message counts on a page with at most so many characters in lines of prose, which are lines of at least so many characters.
PROSE_MOST, PROSE_LINE = 1_500, 80


def prose_length(text: Column) -> Column:
    """Characters in lines of prose."""
    return F.aggregate(F.split(text, r"\n"), F.lit(0), lambda n, line: n + F.when(F.length(line) >= PROSE_LINE, F.length(line)).otherwise(0))


def title_head(title: Column) -> Column:
    """The page's part of a title, before the site's name."""
    return F.regexp_replace(title, r"\s+(?:[|–—:-]|::|·|»)\s+[^|–—]*$", "")


def residue_kinds(rows: DataFrame, text_col: str = "text", title_col: str = "title") -> DataFrame:
    """``rows`` with ``residue``: an array of 'slot', 'default_title', 'filler', 'error', 'notice', empty where there is none.

    Null text or title counts as empty; an empty text is a failed fetch and has no residue, whatever its title says. The
    sentences that a page's frame has about scripts in passing don't demand them and don't count. Texts are searched whole.
    """
    text, title = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(title_col), F.lit(""))
    head = title_head(title)
    found = F.array_compact(
        F.array(
            F.when(slots_left(text) | slots_left(title), "slot"),
            F.when(head.rlike(_whole_line(_DEFAULT_TITLES)), "default_title"),
            F.when(has_filler(text) | has_filler(head), "filler"),
            F.when(((text.rlike(ERRORS) | text.rlike(REFERENCE)) & (prose_length(text) <= PROSE_MOST)) | head.rlike(ERRORS) | head.rlike(REFERENCE), "error"),
            F.when((text.rlike(NOTICES) & (prose_length(text) <= PROSE_MOST)) | head.rlike(NOTICES), "notice"),
        )
    )
    return rows.withColumn("residue", F.when(F.trim(text) != "", found).otherwise(F.array().cast("array<string>")))
