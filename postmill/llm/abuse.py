"""Problem 7: abusive, hateful and sexual sentences.

Every distinct word is matched with the lexicon by a Levenshtein automaton run through a trie of the lexicon's terms, after spelling tricks
(digits and signs for letters, spaced or dotted letters, stretched or starred letters) are undone. From four letters on, a word of letters may be one edit from a
term anywhere in the lexicon (two neighbours that change places are one edit), from nine letters on two; terms that share what is left of the word after so many
deletions are looked up and compared. A word that the corpus has about as often as the term is no misspelling of it. Terms then have to stand in a context: an insult near people it is
aimed at, a threat or an explicit act as a sequence of terms. A match that a quotation encloses, or a rejection in the words around it, has a lower score. There
is no rule for products: words about things match no pattern, since the patterns ask for people.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.canon import canonicalise
from postmill.llm.common import table

CATEGORIES = ("abuse", "hate", "sexual")

# Insults for people, in six languages, without accents.
INSULTS = """
idiot idiots moron morons imbecile imbeciles cretin cretins dumbass dumbasses bastard bastards pig pigs scumbag scumbags scum parasite parasites loser losers asshole assholes arsehole jackass dickhead twat wanker prick bitch retard retards dimwit halfwit dipshit shithead maggot maggots lowlife
idiota idiotas imbecil imbeciles payaso payasos inutiles basura gilipollas cabron cabrones estupidos cretino cretinos subnormal subnormales tarado tarados capullo capullos escoria
idioten schwachkopf schwachkopfe vollpfosten versager trottel arschloch arschlocher abschaum depp deppen dreckstuck vollidiot vollidioten spinner penner wichser missgeburt nichtsnutz nichtsnutze
abruti abrutis cretins ordure ordures dechet dechets connard connards idiots bouffon bouffons salaud salauds encule encules debile debiles minable minables raclure
idioti cretini imbecille imbecilli deficiente deficienti stronzo stronzi immondizia fallito falliti pagliaccio pagliacci coglione coglioni incapaci feccia
imbecis lixo otario otarios palhaco palhacos babaca babacas vagabundo vagabundos burros canalha canalhas incompetentes
""".split()  # fmt: skip
# Sequences of terms by category. A blank stands for nothing, "_" for up to four words and "__" for up to ten; {I} is any insult, {G} any group.
PATTERNS = {
    "abuse": """
i|ill|we|somebody _ kill|murder|stab|strangle|shoot|hurt you|him|her|them; slit your|his|her throat; burn your|his|her|their house; watch your back; you|he|she|they deserve|deserves to die|suffer; hope you|he|she|they _ die|dies|suffer|suffers|burn|rot; go die; go hang yourself; go to hell; fuck you; you _ piece of shit|garbage|trash|filth; you are|re _ pathetic|worthless|disgusting|subhuman|vermin; you pathetic|worthless|disgusting|stupid|ugly|fat|dumb _ cow|pig|fool|fools|person|people|creature|woman|man|human|brat; stupid|ugly|fat|dumb cow|bitch|whore|slut; nobody would miss you; world _ better without you;
bring|bringe dich|euch um; stech|steche dich ab; schlag|schlage dich|euch tot; fick dich; verpiss dich; stirb endlich; verrecke|verreckt; dreckiges|dummes schwein; du bist _ abschaum|wertlos|ekelhaft|erbarmlich; dumme|blode|fette kuh|schlampe|hure;
voy a matarte|mataros; te voy a matar|romper|partir; hijo|hija|hijos de puta; vete a la mierda; ojala te mueras|pudras; muerete; eres _ patetico|patetica|asqueroso|asquerosa|escoria; puta gorda|asquerosa|zorra;
vais te|vous tuer|crever; je te|vous tue|tuerai|creve; va te faire foutre; fils de pute; nique ta mere; tu es _ pathetique|minable|degoutant|degoutante; sale pute|conne|connard|porc; creve charogne;
ti|vi ammazzo|uccido|spacco; figlio|figlia|figli di puttana; vai a farti fottere; sei _ patetico|patetica|schifoso|schifosa; devi morire; fai schifo _ persona|gente; brutta|lurida troia|puttana|vacca;
vou te matar|quebrar|arrebentar; filho|filha|filhos da puta; vai se foder; vai tomar no cu; voce e _ patetico|patetica|nojento|nojenta; voce merece morrer|sofrer; sua vaca|puta|vadia;
you _ {I}; your _ {I}; {I} _ you; every|all _ {I}; of you __ {I}; manager|rep|courier|agent|person|staff|cashier|clerk|guy|woman|boss|driver|owner|seller _ {I}; these|those|such|bunch _ {I}; lying|worthless|complete|utter {I};
hope|hopes _ chokes|choke|dies|die; whoever _ chokes|choke; chokes on it; break|breaks|smash _ fingers|legs|bones|arms|teeth|neck; find|finds out where _ sleeps|lives; make|makes them|him|her|you sorry; too dim|stupid|dumb|thick to breathe|live; walk into traffic; shut your|that mouth|trap|face; shut up; drop dead; kill yourself|yourselves; rot in hell; beat|punch _ up|face; deserve|deserves _ beating|thrashing; spit on you;
ojala __ ahogue|ahoguen|muera|mueran; callate|callaos; cierra la boca; merecen|merece _ paliza|hostia; ojala os echen; basura humana; sois _ {I}; esos|estos|unos|todos|sus|tus {I}; eres _ {I}; son _ {I}; pedazo de {I}; romperle|romper|partir _ dedos|piernas|cara|dientes; se donde vives|vive;
erstickt|ersticken|ersticke daran; halt|haltet _ klappe|fresse|maul; stuck dreck; sollte|soll|musste man verprugeln|schlagen|verhauen; gehort|gehoren entlassen|verprugelt|eingesperrt; ihr|du|sie _ {I}; solche|diese {I}; finger|knochen|beine _ brechen; ich finde heraus wo _ schlaft|wohnt;
etouffer avec; etouffe|etouffent avec; ferme la; ferme ta gueule; fermez la; espece de {I}; meritent|merite _ raclee|baffe|correction; crache dessus; vous etes _ {I}; tu es _ {I}; ces|tous|bande {I}; bande de {I}; casser|briser _ doigts|jambes|dents; sais ou _ dort|habite;
ci si strozzi; si strozzi|strozzino con; chiudi _ bocca; stai zitto|zitta; pezzo di {I}|merda; siete _ {I}; sei _ {I}; meritano|merita _ botte|legnate|lezione|bastonate; quegli|quei|questi|quelli|tutti {I}; spero che __ strozzi|muoia|crepi; rompere|spezzare _ dita|gambe; sputo addosso;
se engasgue|engasguem; tomara que __ engasgue|morra|engasguem; cala|calem _ boca; lixo humano; voces sao _ {I}; voce e _ {I}; deviam sumir|morrer; merecem|merece _ surra; esses|aqueles|seus|uns|todos {I}; seu|sua {I}; bando de {I}; quebrar|quebrem _ dedos|pernas|dentes; cuspo em
""",
    "hate": """
all|every|these|those|you {G} _ deserve|must|should _ die|burn|hang|disappear; {G} _ subhuman|inferior|disease|plague|savages|parasites; no {G} allowed|wanted; {G} _ ruin|ruined|destroy|destroyed _ country|nation; {G} _ not human; dirty|filthy|stinking|bloody {G}; {G} belong in|back _ kitchen|zoo|cage|jungle; {G} _ too stupid|lazy|dirty to; get rid of _ {G}; {G} _ lower race;
{G} _ abschieben|vergasen|untermenschen|parasiten|pest; dreckige|dreckigen|verdammte|verfluchte {G}; hasse alle|diese {G}; {G} gehoren _ kuche|kafig|gas|lager; {G} _ minderwertig|minderwertige;
{G} _ plaga|inferiores|parasitos; putos|sucios|malditos|asquerosos {G}; odio a _ {G}; {G} _ raza inferior;
{G} _ inferieurs|parasites; sales {G}; hais|deteste tous|toutes|ces les|{G}; {G} _ race inferieure;
{G} _ inferiori|parassiti; sporchi|maledetti|luridi {G}; odio tutti _ {G}; {G} _ razza inferiore;
{G} _ inferiores|parasitas; sujos|malditos|nojentos {G}; odeio todos|esses|estes {G}; {G} _ raca inferior;
{G} _ born thieves|criminals|liars; born thieves _ them; {G} __ vermin|filth|scum|filthy|animals|rats|cockroaches; they are vermin|filth|animals; that lot __ vermin; breed like rats|rabbits|vermin; filthy lot; throw|kick|send|get _ {G} _ out|back; throw|kick every|all _ out of the country; better off before _ allowed; have no business _ brains|anything; {G} _ brains _ small; hired _ filthy; {G} should|must _ deported|exterminated|shot|gassed; gas the; hate all _ {G}; {G} _ go back to;
ladrones de nacimiento; echar|expulsar|sacar del pais a; habria que echar|expulsar _ pais; {G} _ ladrones|ratas|escoria|plaga|basura; crian|reproducen como ratas|conejos; tipico de los _ ladrones|vagos;
geborene|geborenen diebe|verbrecher; aus dem land gejagt|geworfen|vertrieben; pack gehort; {G} _ ungeziefer|ratten|abschaum|diebe|gesindel; vermehren sich wie ratten|karnickel|kaninchen; {G} _ raus;
voleurs nes; chasser _ du pays; dehors _ {G}; {G} _ vermine|rats|racaille|voleurs; reproduisent comme des rats|lapins;
ladri dalla nascita; ladri nati; cacciare|buttare|cacciati _ paese; bisognerebbe cacciare _ paese; {G} _ parassiti|feccia|ratti|ladri; riproducono come topi|ratti|conigli;
ladroes de nascenca; ladroes natos; expulsar|expulsos|botar|enxotar _ pais; deveriam|devia|deviam expulsar _ pais; {G} _ vermes|ratos|escoria|ladroes; reproduzem como ratos|coelhos
""",
    "sexual": """
blowjob|blowjobs|handjob|gangbang|cumshot|deepthroat|masturbating|masturbated; nude|naked|topless girls|women|teens|wives|webcam; hard|erect|throbbing cock|dick|penis; wet|tight pussy|cunt; spread her|my|your|his legs _ wide|fuck|naked; cum|came in|on|inside her|his|my|your _ mouth|face|tits|pussy; sex tape|chat|cam|slave; paid sex; sex for money|cash; ride|riding my|his|your cock|dick; take off my|her|your panties|bra|underwear _ show|cam|naked|slowly;
steifer|steifen|harter schwanz; nackte frauen|madchen|weiber; geile titten; sex chat|treffen|cam; sex gegen geld; schwanz lutschen|blasen; muschi lecken|ficken;
chupar|chupame|chupa la|mi polla|verga; chicas|mujeres desnudas; sexo por dinero|webcam; follarte|follarme duro|toda|esta;
suce|sucer ma|sa|mon bite|queue; filles|femmes nues; sexe contre|par argent|webcam; te baiser|lecher toute|partout|fort;
succhiami|succhiare il|mio cazzo; ragazze|donne nude; sesso a|per pagamento|soldi; scoparti|scoparmi tutta|forte;
chupa|chupar meu|o pau; garotas|meninas|mulheres nuas|peladas; sexo por dinheiro|webcam; te foder|comer toda|gostoso;
used|worn panties|underwear|knickers _ pay|buy|sell; sell _ used panties|underwear|knickers; nude|naked|topless pics|pictures|photos|selfies|videos; pics|photos nude|naked; cam show _ naked|nude|wet|wild; fully|totally naked|nude after|on; licking|lick|sucking|kissing _ naked body; every inch of her|his; so horny; horny _ sex; had|have sex _ on|with|in|twice; want|wants|wanna to fuck; hot singles _ fuck|tonight|sex; fuck|fucking _ tonight|me|hard; suck my|his dick|cock; blow|hand job; anal|oral sex; dick|cock|pussy pic|pics; porn _ video|watch|site; tits _ show|pics|out;
fotos desnuda|desnudas|desnudo; fotos _ desnuda|desnudas; quieren|quiero|quiere follar; follar esta noche; solteras calientes _ follar|noche; bragas usadas; desnuda _ camara; tan cachondo|cachonda; tuve sexo|relaciones en|con; lamiendo|lamer _ cuerpo desnudo; todo por camara;
nacktbilder; nacktfotos; wollen|will|wollte _ ficken; heute nacht ficken; geile singles|girls|frauen|manner; getragene slips|hoschen|unterwasche; nackt vor der kamera; so geil dass; so geil _ sex; hatte sex auf|mit; nackten korper _ lecken; leckte|lecken _ nackten korper; vor der kamera _ alles;
photos nue|nues|nu; photos _ nue|nues; veulent|veux|veut baiser; baiser ce soir; filles chaudes _ soir|baiser; culottes usagees|portees; nue _ camera; tellement excite|excitee; fait l amour sur; couche sur _ deux fois; leche|lecher|lechait _ corps nu; tout devant la camera;
foto nuda|nude|nudo; foto _ nuda|nude; vogliono|voglio|vuole scopare; scopare stasera|stanotte; ragazze calde|single calde _ scopare|stasera|stanotte; mutandine usate; nuda _ webcam|telecamera|cam; cosi eccitato|eccitata; fatto sesso su|sul|sulla|con; leccare|leccando _ corpo nudo; di tutto in cam|webcam|camera;
fotos nua|nuas|pelada|peladas; fotos _ nua|nuas|pelada; querem|quero|quer transar|foder|trepar; transar hoje|esta noite; solteiras quentes|gostosas _ transar|noite; calcinhas usadas; nua _ camera|cam; tao excitado|excitada; com tanto tesao; fiz sexo em|na|no|com; transei _ na|no|em; lambendo|lamber _ corpo nu; faco tudo|de tudo na|pela camera
""",
}
# Words for groups of people that one belongs to.
GROUPS = """
foreigners foreigner immigrants immigrant refugees refugee women woman migrants muslims jews christians blacks whites gays lesbians gypsies asians africans arabs folk
auslander auslandern fluchtlinge frauen zigeuner juden muslime schwule extranjeros extranjero inmigrantes mujeres gitanos judios moros etrangers etranger immigres femmes juifs musulmans arabes forestieri stranieri immigrati donne zingari ebrei forasteiros estrangeiros imigrantes mulheres ciganos judeus
""".split()  # fmt: skip
#: Names of peoples by their form: a capital and an ending of peoples' names.
PEOPLE = re.compile(r"[A-Z][a-z]+(?:ians?|ites?|ish|ese|iens?|ier|ler|ianos?|ani|ini|ese|esi)")
# Words around a quotation or rejection of such language, and ways to start one.
REJECT = re.compile(
    r"\b(?:nobody|no one|noone|nadie|niemand|personne|nessuno|ninguem) (?:should|must|ought|has the right|deberia|debe|sollte|darf|ne devrait|ne doit|dovrebbe|deve|deveria|devia)\b|\b(?:i|we|and) (?:have )?(?:reported|flagged|blocked)\b|\bi reported\b|\b(?:wrote|called|calls|calling|says|said|shouted|posted|commented)\s+(?:me |us |him |her |them |someone )?[\"'“‘«(]"
    r"|\b(?:denuncie|reporte|gemeldet|signale|segnalato|denunciei|reportei)\b|\b(?:escribio|llamo|schrieb|nannte|a ecrit|m a traite|ha scritto|escreveu|chamou)\s+(?:me |mich |mir )?[\"'“‘«„(]|\bnot ok(?:ay)? to call\b|\bunacceptable\b|\b(?:insult|insults|slur|slurs)\b|\bplease (?:stop|don t)\b"
)
#: Where the reach of a rejection ends: before the match at words to somebody, after it at any pause.
ADDRESSED = re.compile(r"[;:]|, ?(?:and |y |und |et |e )?(?:you|u|du|ihr|sie|tu|te|usted|ustedes|vosotros|vous|voi|lei|voce|voces)\b")
PAUSE = re.compile(r"[,;:]|\b(?:and|but|und|aber|y|pero|et|mais|e|ma|mas)\b")
OPENERS, CLOSERS = "\"“„«‘(", {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’", "(": ")"}
# Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e", "£": "l"}
# Spellings of the same sound.
SOUNDS = (("oo", "u"), ("ph", "f"), ("kk", "ck"), ("x", "cks"), ("z", "s"))
# Ordinary words one or two edits from a term.
ORDINARY = frozenset("batch ordre ordres ordner idee ideas idea closer laser loses lover poser lower ideal pigment basta bastan basic paragraph moral spinnen trotte gehort cretan naked baked fingers figures sleeves lies choose chose lines paliza pagina sexo sei seis strong stronger fallido falling dechets parasol pic debit debits leger incapable spinning inutile prices price pricy".split())

SENTENCE = re.compile(r"(?<=[.!?…])[\"”»')\]]*\s+|\n+")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]){2,}[^\W\d_](?![^\W_])")
PARTS = re.compile(r"[-–—/’']")
STRIP = ".,;:!?…\"'“”‘’«»()[]{}<>¿¡"


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c)).replace("ß", "ss").replace("œ", "oe")


def shortened(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def edits(a: str, b: str) -> int:
    """Edits between two words; two neighbours that change places are one."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
    return row[-1]


class Lexicon:
    """The terms of the patterns in a trie, and the patterns over them.

    ``counts`` has how many texts of the corpus hold a word, for terms and words near them.
    """

    def __init__(self, counts: dict[str, int] | None = None):
        self.counts = counts or {}
        self.patterns: list[tuple[str, list[frozenset[str] | int]]] = []
        insults, groups = frozenset(map(fold, INSULTS)), frozenset(GROUPS)
        for category, text in PATTERNS.items():
            for line in text.replace("\n", " ").split(";"):
                steps = []
                for x in line.split():
                    names: set[str] = set()
                    for y in x.split("|"):
                        names |= insults if y == "{I}" else groups | {"{G}"} if y == "{G}" else {y}
                    steps.append(4 if x == "_" else 10 if x == "__" else frozenset(names))
                if steps:
                    self.patterns.append((category, steps))
        self.exact = frozenset(t for _, steps in self.patterns for s in steps if not isinstance(s, int) for t in s)
        # Short and common words of the patterns only count when spelled right.
        strong = insults | {t for c, steps in self.patterns if c != "abuse" for s in steps if not isinstance(s, int) for t in s if len(t) >= 3} | {t for s in self.patterns for x in s[1] if not isinstance(x, int) for t in x if len(t) >= 6}
        self.strong = frozenset(strong)
        self.trie: dict = {}
        for t in strong:
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
        self.shorter: dict[int, dict[str, set[str]]] = {1: {}, 2: {}}
        for most, index in self.shorter.items():
            for t in strong:
                for k in shortened(t, most) if len(t) >= (3 if most == 1 else 7) else ():
                    index.setdefault(k, set()).add(t)
        self.later = [[x for x in steps[1:] if not isinstance(x, int)] for _, steps in self.patterns]
        self.first: dict[str, list[int]] = {}
        for i, (_, steps) in enumerate(self.patterns):
            for t in steps[0]:
                self.first.setdefault(t, []).append(i)

    def near(self, word: str, most: int) -> set[str]:
        """Terms within ``most`` edits of a word; a star in the word stands for any letter. The first letter must be the same.

        The automaton's state is the row of edits that the prefix read so far needs; a branch of the trie ends where every entry is above ``most``.
        """
        if not most and "*" not in word:
            return {word} & self.strong
        found: set[str] = set()
        stack = [(self.trie.get(word[0]), [min(most + 1, abs(i - 1)) for i in range(len(word) + 1)])] if word and word[0] in self.trie else []
        while stack:
            node, row = stack.pop()
            if "" in node and row[-1] <= most:
                found.add(node[""])
            for c, below in node.items():
                if c:
                    new = [row[0] + 1]
                    for i, w in enumerate(word):
                        new.append(min(row[i] + (w != c and w != "*"), row[i + 1] + 1, new[i] + 1))
                    if min(new) <= most:
                        stack.append((below, new))
        return found

    def close(self, word: str) -> set[str]:
        """Terms that the word is a misspelling of by its letters: within one edit from four letters on, two from nine."""
        most = 0 if len(word) < 4 else 1 if len(word) < 9 else 2
        if not most:
            return self.near(word, 0)
        index = self.shorter[most]
        return {t for t in {t for k in shortened(word, most) for t in index.get(k, ())} if edits(word, t) <= most}

    def rarer(self, word: str, terms: set[str]) -> set[str]:
        """The terms that the corpus has more than twice as often as the word; all of them if it has the word only once or twice."""
        n = self.counts.get(word, 0)
        return terms if n <= 2 else {t for t in terms if self.counts.get(t, 0) > 2 * n}

    def terms(self, token: str) -> frozenset[str]:
        """The terms a token can stand for."""
        plain = fold(token.strip(STRIP + "*"))
        if not plain:
            return frozenset()
        out = {plain} & self.exact
        if PEOPLE.fullmatch(token.strip(STRIP)):
            out.add("{G}")
        tricky = any(c in LEET for c in plain) and any(c.isalpha() for c in plain) or "*" in token.strip(STRIP)
        word = "".join(LEET.get(c, c) for c in fold(token.strip(STRIP)))
        word = re.sub(r"([^*])\1{2,}", r"\1", word)
        word = re.sub(r"[^a-z*]", "", word) if tricky or len(word) != len(plain) else word
        if plain in self.exact or plain in ORDINARY or not word or word.isdigit():
            return frozenset(out)
        if tricky:
            if sum(c.isalpha() for c in plain) >= 1 and len(word) >= 3 and sum(c.isdigit() for c in plain) < len(plain):
                out |= self.near(word, 0) or (self.near(word, 1) if len(word) >= 6 else set())
        else:
            out |= self.rarer(plain, self.close(word)) | self.near(word, 0)
        for a, b in SOUNDS:
            if a in word:
                out |= self.near(word.replace(a, b), 0)
        return frozenset(out)


def _joined(m: re.Match) -> str:
    return re.sub(r"[ .*_-]", "", m.group())


def quotations(text: str) -> list[tuple[int, int]]:
    """The stretches between quotation marks or brackets; one that is not closed ends with the text."""
    out, i = [], 0
    while i < len(text):
        if text[i] in OPENERS or text[i] == "'" and (i == 0 or text[i - 1] in " ("):
            close = CLOSERS.get(text[i], "'")
            # An apostrophe inside a word closes nothing.
            end = next((j for j in range(i + 1, len(text)) if text[j] in close and not (text[j] in "'’" and text[j + 1 : j + 2].isalnum())), len(text))
            out.append((i, end))
            i = end
        i += 1
    return out


def rejected(text: str, start: int, stop: int, reach: int = 12) -> bool:
    """Whether the match from ``start`` to ``stop`` of a folded sentence is quoted or rejected.

    A quotation counts if it encloses the match and the sentence rejects or tells who said it; a rejection, if it stands within ``reach`` words
    before the match and nobody is spoken to in between, or within as many after it without a pause.
    """
    cues = [m.span() for m in REJECT.finditer(text)]
    if not cues:
        return False
    if any(a <= start and stop <= b for a, b in quotations(text)):
        return True
    for a, b in cues:
        if text[b - 1] in "\"'“‘«„(":
            continue
        if b <= start and len(text[b:start].split()) <= reach and not any(m.start() < start for m in ADDRESSED.finditer(text, b)):
            return True
        elif stop <= a and len(text[stop:a].split()) <= reach and not PAUSE.search(text[stop:a]):
            return True
        elif a < stop and start < b:
            return True
    return False


class Scorer:
    """Scores sentences; what a word stands for is worked out once for each distinct word."""

    def __init__(self, counts: dict[str, int] | None = None):
        self.lexicon = Lexicon(counts)
        self.known: dict[str, frozenset[str]] = {}

    def _terms(self, token: str) -> frozenset[str]:
        v = self.known.get(token)
        if v is None:
            if len(self.known) > 400_000:
                self.known.clear()
            v = self.lexicon.terms(token)
            self.known[token] = v
        return v

    def sentence(self, text: str) -> dict[str, float]:
        """Category -> score of one sentence, 0 to 1; categories at 0 are left out."""
        plain = SPACED.sub(lambda m: " " + _joined(m) + " ", text)
        tokens = plain.split()
        if not plain.isascii() or "-" in plain or "'" in plain or "/" in plain:
            tokens = [p for t in tokens for p in ([t] if t.isascii() and "-" not in t and "'" not in t and "/" not in t else PARTS.split(t)) if p]
        hits = list(map(self.known.get, tokens))
        if None in hits:
            hits = list(map(self._terms, tokens))
        if not any(hits):
            return {}
        spaced = {m.group(): _joined(m) for m in SPACED.finditer(text)}
        if spaced:  # an article before spaced letters is drawn into them
            for i, t in enumerate(tokens):
                if t in spaced.values() and not hits[i]:
                    hits[i] = frozenset(x for k in (1, 2) for x in self.lexicon.near(fold(t)[k:], 0))
        out: dict[str, float] = {}
        spots = None
        # A pattern is only followed if the sentence holds a term of each of its steps.
        present = frozenset().union(*hits)
        possible: dict[str, list[int]] = {}
        for t in present:
            for p in self.lexicon.first.get(t, ()):
                for x in self.lexicon.later[p]:
                    if x.isdisjoint(present):
                        break
                else:
                    possible.setdefault(t, []).append(p)
        if not possible:
            return {}
        for i, h in enumerate(hits):
            for t in h:
                for p in possible.get(t, ()):
                    category, steps = self.lexicon.patterns[p]
                    if out.get(category) == 1.0:
                        continue
                    for last in self._ends(hits, i + 1, steps, 1):
                        if spots is None:
                            folded = fold(text)
                            spots = self._spots(folded, tokens, spaced)
                        if not rejected(folded, spots[i][0], spots[last][1]):
                            out[category] = 1.0
                            break
                        out[category] = 0.3
        return out

    @staticmethod
    def _spots(folded: str, tokens: list[str], spaced: dict[str, str]) -> list[tuple[int, int]]:
        """Where each token stands in the folded sentence."""
        out, at = [], 0
        written = {v: k for k, v in spaced.items()}
        for t in tokens:
            w = fold(written.get(t, t))
            i = folded.find(w, at)
            i = at if i < 0 else i
            core = len(w) - len(w.lstrip(STRIP))
            at = min(len(folded), i + len(w))
            out.append((i + core, max(i + core, i + len(w.rstrip(STRIP)))))
        return out

    def _ends(self, hits, at: int, steps, k: int) -> Iterator[int]:
        """The last token of each way in which the pattern goes on from ``at``."""
        if k == len(steps):
            yield at - 1
            return
        reach = 1
        if isinstance(steps[k], int):
            k, reach = k + 1, 1 + steps[k]
            if k == len(steps):
                yield at - 1
                return
        for j in range(at, min(len(hits), at + reach)):
            if steps[k] & hits[j]:
                yield from self._ends(hits, j + 1, steps, k + 1)

    def text(self, text: str) -> dict[str, float]:
        """Category -> the highest score of its sentences."""
        out: dict[str, float] = {}
        for s in SENTENCE.split(text):
            if s:
                for c, v in self.sentence(s).items():
                    out[c] = max(v, out.get(c, 0.0))
        return out


_kept: list = [None, None]


def _scorer(counts: dict[str, int]) -> Scorer:
    """The scorer of these counts; workers that run several tasks keep it with what it knows of words."""
    if _kept[0] is not counts:
        _kept[:] = counts, Scorer(counts)
    return _kept[1]


def _score(counts):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(counts.value)
        for batch in batches:
            found = [scorer.text(t) if t else {} for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], *[pa.array(np.array([f.get(c, 0.0) for f in found])) for c in CATEGORIES]], ["key", *CATEGORIES])

    return score


def word_counts(rows: DataFrame) -> dict[str, int]:
    """In how many texts the terms, and words that could be misspellings of them, occur; from rows (text), words of three texts or more.

    The words near the lexicon are bounded by its size, whatever the corpus' size.
    """

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for part in parts:
            folded = [fold(w) for w in part["word"].to_pylist()]
            keep = [i for i, w in enumerate(folded) if w in lexicon.exact or lexicon.close(w)]
            yield pa.RecordBatch.from_arrays([pa.array([folded[i] for i in keep], pa.string()), part["n"].take(pa.array(keep, pa.int64()))], ["word", "n"])

    words = rows.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}]+"))).alias("word")).where("length(word) between 4 and 40")
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 3")
    return {r[0]: r[1] for r in counts.mapInArrow(near, "word string, n long").groupBy("word").agg(F.sum("n")).collect()}


def score_texts(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, abuse, hate, sexual): scores from 0 to 1 for every row; 0 for NULL, empty and blank texts.

    A score is that of the worst sentence: 1 for a pattern in its context, 0.3 where it is quoted or rejected. Texts are read as a reader
    sees them (problem 1), whole. Repeated keys give a row each; an empty table gives an empty result.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(col).alias("text"))
    counts = df.sparkSession.sparkContext.broadcast(word_counts(rows.select("text")))
    return canonicalise(rows, "text", "text").mapInArrow(_score(counts), "key long, abuse double, hate double, sexual double")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_texts(table(spark, sf_dir, "raw_posts"), "id", "posts")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])).alias("x")
    return scores.select(F.col("key").alias("id"), each).where("x.score >= 0.5").select("id", "x.category").distinct()


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each value of social, its posts and the shares with each category."""
    posts = table(spark, sf_dir, "raw_posts").select("id", "social")
    scores = score_texts(table(spark, sf_dir, "raw_posts"), "id", "posts")
    rate = [F.avg((F.col(c) >= 0.5).cast("double")).alias(c) for c in CATEGORIES]
    return posts.join(scores.withColumnRenamed("key", "id"), "id").groupBy("social").agg(F.count("*").alias("posts"), *rate)


def p7_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviewers' categories against the scores: held-out accuracy."""
    scores = score_texts(table(spark, sf_dir, "raw_posts"), "id", "posts").withColumnRenamed("key", "post_id")
    hit = F.filter(F.array(*[F.when(F.col(c) >= 0.5, F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull())
    return table(spark, sf_dir, "review_labels").join(scores, "post_id").groupBy("category", F.array_join(hit, "+").alias("scored")).agg(F.count("*").alias("posts"))


QUERIES = {"p7_found": p7_found, "p7_rates": p7_rates, "p7_reviews": p7_reviews}
ORACLE: dict[str, str] = {}
