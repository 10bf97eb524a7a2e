"""Problem 5: lines of the page around the author's text.

First pass: each line (block) is decided by its stop-word density, length, link density and parts. Blocks of three parts or more without stop words (menus,
paths), counters, blocks of links, blocks made mostly of the words pages are made of in which nobody speaks for themselves, and sentences in the page's own
voice belong to the page; blocks with enough stop words and length, and list items, to the author. Second pass: short blocks that
remain open take the class of the nearest decided block on either side, at the ends of a text of the one they have; the author's wins a tie.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.canon import canonicalise
from postmill.llm.common import table

# Menu, button and footer labels of web pages in six languages.
MENU = {x.strip() for x in """
home; search; help; forum; forums; reviews; blog; newest; latest; popular; my lists; my account; topics; deals; about us; about; stores; shop; log in; login; log out; sign in; sign up; register; subscribe; menu; categories; archive; faq; contact; contact us; careers; press; privacy; privacy policy; terms; terms of use; terms of service; imprint; legal; legal notice; cookies; cookie settings; sitemap; share; like; reply; comment; comments; upvote; downvote; follow; save; report; report this post; see translation; see more; advertisement; sponsored; promoted; back to top; jump to latest; load more comments; write a comment; follow us; follow us on social media; accept all; reject all; accept; decline; manage preferences; settings; next; previous; next page; previous page; read more; related; you may also like; top posts this week; skip to content; skip to main content; edited; newsletter; unsubscribe; download the app; get the app;
startseite; suche; hilfe; tests; angebote; filialen; themen; über uns; anmelden; abmelden; registrieren; kontakt; karriere; presse; datenschutz; agb; impressum; teilen; gefällt mir; antworten; kommentieren; melden; beitrag melden; nach oben; anzeige; werbung; newsletter abonnieren; alle akzeptieren; ablehnen; einstellungen; einstellungen verwalten; mehr anzeigen; übersetzung anzeigen; weiter; zurück; bearbeitet; das könnte sie auch interessieren; neueste; beliebt; meine listen; kommentar schreiben;
inicio; buscar; ayuda; foros; opiniones; ofertas; tiendas; temas; quiénes somos; entrar; salir; registrarse; contacto; empleo; prensa; privacidad; condiciones; aviso legal; compartir; me gusta; responder; comentar; denunciar; volver arriba; publicidad; patrocinado; suscríbete al boletín; aceptar todo; rechazar todo; configurar; ver más; ver traducción; siguiente; anterior; editado; también te puede interesar; mis listas; novedades;
accueil; recherche; aide; avis; bons plans; magasins; sujets; à propos; connexion; déconnexion; inscription; recrutement; confidentialité; conditions; mentions légales; partager; j'aime; répondre; commenter; signaler; haut de page; publicité; sponsorisé; abonnez-vous à la lettre; tout accepter; tout refuser; gérer mes choix; voir plus; voir la traduction; suivant; précédent; modifié; vous aimerez aussi; mes listes; nouveautés;
cerca; aiuto; recensioni; offerte; negozi; argomenti; chi siamo; accedi; esci; registrati; contatti; lavora con noi; stampa; privacy; condizioni; note legali; condividi; mi piace; rispondi; commenta; segnala; torna su; pubblicità; sponsorizzato; iscriviti alla newsletter; accetta tutto; rifiuta tutto; gestisci preferenze; mostra altro; vedi traduzione; successivo; precedente; modificato; potrebbe interessarti anche; le mie liste; novità;
início; pesquisar; busca; buscar; ajuda; fóruns; avaliações; opiniões; lojas; tópicos; quem somos; sobre nós; sair; cadastrar; cadastre-se; contato; contacto; carreiras; trabalhe conosco; imprensa; privacidade; termos; condições; aviso legal; compartilhar; partilhar; curtir; gosto; denunciar; voltar ao topo; publicidade; patrocinado; assine a newsletter; aceitar tudo; recusar tudo; configurar; gerenciar preferências; ver mais; ver tradução; próximo; você também pode gostar; minhas listas; novidades; entrar; ofertas; temas; comentar; responder; início
""".replace("\n", " ").split(";")}  # fmt: skip
MENU.discard("")

# Patterns of counters and times beside a post.
COUNTER = re.compile(
    r"(?:upvote|like|likes|views|shares|comments)?\s*[·:]?\s*\d[\d.,]*\s*[km]?\s*(?:comments?|shares?|likes?|views?|upvotes?|replies|h|min|min read|hours? ago|days? ago|std\.?|stunden|kommentare?|antworten|aufrufe|comentarios?|respuestas|vistas|commentaires?|réponses|vues|partages|commenti|risposte|condivisioni|visualizzazioni|comentários|respostas|visualizações|partilhas|compartilhamentos)?"
    r"|(?:vor|hace|il y a|há)\s+\d+\s*(?:h|std\.?|min\.?|minuten|stunden|tagen|horas?|días|heures?|jours|dias)|\d+\s*(?:h|ore|min|giorni)\s*fa|\d+\s*h\s*atrás"
)
# Patterns of whole lines or sentences in the page's voice.
VOICES = (
    r"(?:we|this (?:web)?site|our (?:web)?site|this page) (?:use|uses|store|stores|set|sets)\b.*(?:cookies?|data|device).*",
    r"by (?:continuing|using|browsing)\b.*(?:you )?(?:agree|accept|consent).*",
    r"your privacy\b.*", r"terms of (?:use|service)\b.*(?:apply|content).*", r"powered by .*", r"follow us\b.*", r"(?:sign up|subscribe) (?:for|to) our .*", r"\d+ (?:people|users|guests|visitors) (?:are|is) (?:viewing|reading|here|online).*",
    r"(?:top|most read|popular|latest) (?:posts?|articles|stories|topics)\b.*", r"trending (?:in|on|now)\b.*", r"related:? \d+ .*", r"related (?:posts|articles|topics)\b.*", r"you (?:may|might) also like.*", r"edited · .*", r"(?:©|\(c\)|copyright)\s*.*", r".*\ball rights reserved\.?",
    r"wir (?:verwenden|nutzen|setzen)\b.*cookies.*", r"diese (?:seite|website|webseite) (?:verwendet|nutzt|speichert|setzt)\b.*", r"(?:mit der nutzung|durch die nutzung|wenn sie fortfahren)\b.*", r"ihre privatsphäre\b.*", r"(?:beliebt|im trend) (?:in|bei)\b.*", r"ähnliche (?:beiträge|themen)\b.*", r".*\balle rechte vorbehalten\.?", r"\d+ (?:personen|nutzer|leute) (?:sehen|lesen)\b.*", r"es gelten die nutzungsbedingungen.*", r"folgen sie uns\b.*", r"das könnte (?:sie|dich) auch .*",
    r"(?:usamos|utilizamos|este sitio (?:usa|utiliza|guarda|almacena))\b.*(?:cookies|datos|dispositivo).*", r"(?:si|al) contin[uú]a(?:r|s)?\b.*(?:acepta|cookies).*", r"(?:su|tu) privacidad\b.*", r"tendencias? (?:en|de)\b.*", r"\d+ (?:preguntas|temas|respuestas) relacionad[ao]s.*", r".*\btodos los derechos reservados\.?", r"\d+ personas (?:están )?(?:viendo|leyendo).*", r"síguenos\b.*",
    r"(?:nous utilisons|ce site (?:utilise|stocke))\b.*", r"en (?:poursuivant|continuant)\b.*(?:accept|cookies).*", r"votre vie privée\b.*", r"tendances? (?:chez|sur|dans)\b.*", r"\d+ sujets (?:similaires|liés).*", r".*\btous droits réservés\.?", r"\d+ personnes (?:consultent|regardent|lisent).*", r"suivez-nous\b.*",
    r"(?:utilizziamo|usiamo|questo sito (?:usa|utilizza|memorizza))\b.*(?:cookie|dati).*", r"continuando\b.*(?:accett|cookie).*", r"la tua privacy\b.*", r"(?:di )?tendenz[ae] (?:in|su|da)\b.*", r"\d+ (?:domande|argomenti) (?:correlat[ei]|simili).*", r".*\btutti i diritti riservati\.?", r"seguici\b.*",
    r"(?:este site (?:usa|utiliza|guarda|armazena))\b.*(?:cookies|dados).*", r"ao continuar\b.*(?:aceita|concorda|cookies).*", r"(?:a sua|sua) privacidade\b.*", r"em alta (?:em|na|no)\b.*", r"\d+ (?:perguntas|tópicos) relacionad[ao]s.*", r".*\btodos os direitos reservados\.?", r"siga-nos\b.*",
)
# Patterns that begin anywhere are followed only in texts with their fixed part.
ANYWHERE = [x for x in VOICES if x.startswith(".*")]
FIXED = [re.match(r"\.\*(?:\\b)?([^\W\d_]+(?: [^\W\d_]+)*)", x).group(1) for x in ANYWHERE]
VOICE = re.compile("|".join(x for x in VOICES if x not in ANYWHERE))
VOICE_ANYWHERE = re.compile("|".join(ANYWHERE))
# Frequent function words of six languages.
STOP = frozenset("""
the a an and or but of to in on at for from with by is are was were be been it its i my we our you your he she they their this that these those not no so as if than then there here has have had do does did will would can could me us them after before about out up down over just very more most
der die das den dem ein eine einen und oder aber von zu im in am an auf für mit bei aus ist sind war waren es ich wir ihr sie er mein unser nicht kein so als wenn noch nach vor über hat haben habe wird wurde auch nur schon doch denn
el la los las un una unos y o pero de del a al en por para con sin es son era lo le se me mi nos su que no como más muy ya ha han he fue porque aunque
le les des du et ou mais au aux dans sur pour avec sans est sont était je tu il elle on nous vous ils mon ma mes ce cette ces ne pas que qui plus très a ont ai en
il lo gli i uno e ma di del della dei a al alla da dal nel nella su per con senza è sono era io ci mi si che non più molto ha hanno ho questo questa
o os as um uma e mas do da dos das no na nos nas em por para com sem é são eu me nos se que não mais muito já foi tem porque
""".split())  # fmt: skip

# Words of people who speak for themselves or about others, which pages don't use.
SPEAKER = frozenset("i my me mine im i'm i've i'd they their them he she his her ich mein meine meinen meinem mir mich wir uns sie er yo mi mis me nos ellos ella él je j'ai mon ma mes moi il elle ils io mio mia miei mie mi loro lui lei eu meu minha meus minhas mim ele ela eles".split())
# More words that pages are made of.
PAGE_WORDS = frozenset("""
cookie cookies privacy partners device browser recaptcha protected javascript enable newsletter subscribe tweet facebook twitter whatsapp pinterest linkedin instagram telegram view views viewing comments replies helpful account terms policy rights reserved copyright powered site website page yes consent preferences measure visits ads advertising personalised personalized content loading skip navigation copyright print email link copied
browser datenschutzerklärung verwenden akzeptieren zustimmen hilfreich ansehen drucken seite webseite anzeigen cookies utilizamos navegador acepta aceptar imprimir útil página sitio navigateur accepter utilisons imprimer utile page site navigatore accettare utilizziamo stampa utile pagina sito navegador aceitar usamos imprimir útil página site
""".split()) | {w for x in MENU for w in x.split() if w not in STOP and w not in SPEAKER}  # fmt: skip
SITE = re.compile(r"\b(?:we|our|us|your|this (?:page|site|website)|wir|unsere[nr]?|ihre[nr]?|diese (?:seite|website)|este sitio|esta página|nuestr[oa]s?|su|nous|notre|nos|ce site|cette page|votre|vos|questo sito|questa pagina|nostr[oaie]|este site|noss[oa]s?)\b")

MARKS = "·|/>»•–—"
SEPARATOR = re.compile(rf"\s*[{MARKS}]\s*|\s{{2,}}|\s-\s")
LIST_ITEM = re.compile(r"\s*(?:[-*•+–]|\d{1,2}[.)])\s+\S")
LINK = re.compile(r"(?:https?://|www\.)\S+")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
PAGE, AUTHOR, OPEN, BLANK = "page", "author", "open", "blank"


def _label(text: str) -> bool:
    text = text.strip(" .:")
    return text in MENU or bool(text) and COUNTER.fullmatch(text) is not None


def _only_labels(text: str) -> int:
    """How many labels a text without separators is made of; 0 if it holds anything else."""
    words = text.split()
    done = [1] + [0] * len(words)  # by number of words: labels so far, plus one
    for i in range(1, len(words) + 1):
        done[i] = max((done[j] + 1 for j in range(max(0, i - 4), i) if done[j] and _label(" ".join(words[j:i]))), default=0)
        if not any(done[max(0, i - 3) : i + 1]):
            return 0
    return max(0, done[-1] - 1)


def _voiced(text: str) -> bool:
    return VOICE.fullmatch(text) is not None or any(x in text for x in FIXED) and VOICE_ANYWHERE.fullmatch(text) is not None


def _voice(text: str) -> bool:
    """Every sentence, or label before it, is in the page's voice."""
    if _voiced(text):
        return True
    parts = re.split(r"(?<=[.!])\s+", text)
    for part in parts:
        words = part.split()
        cut = next((k for k in range(min(4, len(words)), 0, -1) if _label(" ".join(words[:k]))), 0)
        rest = " ".join(words[cut:])
        if rest and not _label(rest) and (rest == text or not _voiced(rest)):
            return False
    return True


def decide(line: str) -> str:
    """First pass: the class of a line by itself."""
    text = line.strip().lower()
    if not text:
        return BLANK
    if LIST_ITEM.match(line) and not _label(text.lstrip("-*•+– ")):
        return AUTHOR
    words = WORD.findall(text)
    stops = sum(map(STOP.__contains__, words))
    density = stops / len(words) if words else 0.0
    speaks = not SPEAKER.isdisjoint(words)
    # Without a mark between parts, and with single blanks only, there is nothing to split.
    parts = [p for p in SEPARATOR.split(text) if p] if " - " in text or any(c in text for c in MARKS) or " ".join(text.split()) != text else [text]
    labels = sum(map(_label, parts))
    if parts and labels == len(parts) and not text.isdigit() or len(parts) >= 3 and labels >= 0.6 * len(parts):
        return PAGE
    if len(parts) >= 3 and density < 0.15 and not speaks and text[-1] not in ".!?" and all(len(p.split()) <= 4 for p in parts):
        return PAGE
    if not speaks and words:
        own = sum(map(PAGE_WORDS.__contains__, words)) / len(words)
        if own >= 0.4 and (len(words) > 1 or own == 1 and len(text) < 40) and (len(words) <= 8 or SITE.search(text)):
            return PAGE
    if _voice(text) or 2 < _only_labels(text):
        return PAGE
    linked = sum(len(m) for m in LINK.findall(text)) if "://" in text or "www." in text else 0
    if linked > 0.8 * len(text):
        return OPEN if text.count("://") + text.count("www.") < 3 else PAGE
    if text.startswith("#") or not words:
        return AUTHOR
    if len(text) >= 70 or len(text) >= 25 and density >= 0.2 or text[-1] in ".!?" and len(words) > 2:
        return AUTHOR
    return OPEN


def page_lines(lines: list[str]) -> list[bool]:
    """Both passes over the lines of one post."""
    kinds = [decide(x) for x in lines]
    if OPEN in kinds and PAGE in kinds:
        filled = [i for i, k in enumerate(kinds) if k != BLANK]
        known = [kinds[i] for i in filled]
        for n, i in enumerate(filled):
            if known[n] == OPEN:
                back = next((d for d in range(1, n + 1) if known[n - d] in (PAGE, AUTHOR)), None)
                ahead = next((d for d in range(1, len(known) - n) if known[n + d] in (PAGE, AUTHOR)), None)
                before, after = known[n - back] if back else None, known[n + ahead] if ahead else None
                short = len(lines[i].split()) <= 3 and lines[i].rstrip()[-1] not in ".!?:"
                if before is None or after is None:
                    # The first line may be the author's title, so only a very short one follows the page.
                    page = short and (after or before) == PAGE and (before is not None or len(lines[i].split()) <= 2)
                else:
                    page = before == after == PAGE or short and (before if back < ahead else after if ahead < back else AUTHOR) == PAGE
                kinds[i] = PAGE if page else AUTHOR
    return [k == PAGE for k in kinds]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, numbers = [], []
        for key, lines in zip(batch["key"].to_pylist(), batch["lines"].to_pylist()):
            for n, page in enumerate(page_lines([x or "" for x in lines]), 1):
                if page:
                    keys.append(key)
                    numbers.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int64())], ["key", "line_no"])


def find_page_lines(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, line_no) of each line that belongs to the page; lines are separated by newlines and counted from 1.

    NULL, empty and blank texts and blank lines give nothing. Lines are read as a reader sees them (problem 1), whole. Rows that
    share a key are classified one by one. An empty table gives an empty result.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(col).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(col).alias("text"))
    return _seen(rows).mapInArrow(_find, "key long, line_no long")


def _seen(rows: DataFrame) -> DataFrame:
    """The lines of each text, each in canonical form, with their numbers kept."""
    text = F.col("text")
    # Another kind of line break within a line doesn't start a new one; a mark before each line keeps blank lines at the ends
    # of a text, which the canonical form drops. Texts of one line need neither.
    one_line = functools.reduce(Column.__and__, [~F.contains(text, F.lit(c)) for c in "\n\r\v\f\x85\u2028\u2029"])
    marked = F.concat(F.lit("‖"), F.regexp_replace(F.regexp_replace(text, r"[\r\x0B\x0C\x{85}\x{2028}\x{2029}]", " "), "\n", "\n‖"))
    guarded = F.when(one_line, text).otherwise(marked)
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "^‖ ?", ""))
    return canonicalise(rows.withColumn("text", guarded), "text", "text").select(*[c for c in rows.columns if c != "text"], lines.alias("lines"))


def main_text(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, main): each text without the page's lines; NULL stays NULL."""
    rows = df.select(F.col(key).alias("key"), F.col(col).alias("text"))

    @F.pandas_udf("string")
    def main(texts, lines):
        out = []
        for text, seen in zip(texts, lines):
            if text is None:
                out.append(None)
                continue
            flags = page_lines([x or "" for x in seen])
            out.append("\n".join(x for x, page in zip(text.split("\n"), flags) if not page))
        return type(texts)(out)

    seen = canonical_lines(rows)
    return seen.select("key", main("text", "lines").alias("main"))


def canonical_lines(rows: DataFrame) -> DataFrame:
    """The rows, which have ``text``, with ``lines``, the lines of the text in canonical form."""
    marked = _seen(rows.select(F.struct(*rows.columns).alias("row"), "text"))
    return marked.select("row.*", "lines")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_page_lines(table(spark, sf_dir, "raw_posts"), "id", "posts").select(F.col("key").alias("id"), "line_no").distinct()


def p5_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post without the lines of its page."""
    return main_text(table(spark, sf_dir, "raw_posts"), "id", "posts").withColumnRenamed("key", "id")


QUERIES = {"p5_found": p5_found, "p5_main": p5_main}
ORACLE: dict[str, str] = {}
