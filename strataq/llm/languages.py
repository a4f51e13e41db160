"""Which language a text is in, by hashed character n-grams.

Each language has a short seed text, some a list of frequent words too; the n-grams of one to three characters of its words, their edges included, give every
word a log-likelihood in every language. Texts of a sample may adapt the languages they are found to be in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

from strataq.llm.readability import FUNCTION_WORDS

WORDS = re.compile(r"[^\W\d_]+")
BITS = 14
#: Each language's counts are scaled to this total, so that none gains by the length of its seed; SMOOTH is added to every bucket.
TOTAL, SMOOTH = 20_000.0, 0.5
# Seed texts, the first article of the declaration of human rights and everyday sentences about towns and houses.
SEEDS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. The town allows a second house on the lot when the yard is large enough. Which of these rules do we have to follow before the work begins? You can ask the office for a permit, and they will answer within three weeks. There is no other section that would change what was said about fences, roofs and parking.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. La ordenanza permite una vivienda adicional en el distrito cuando el terreno es más grande. Los vecinos pueden asistir a la audiencia y la oficina debe contestar antes de tres semanas. Según el texto de la sección, la altura máxima de los edificios es de seis metros y no se permite un taller sin permiso. ¿Cuántas zonas hay y qué se puede hacer en ellas?",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Le règlement autorise un second logement dans la zone lorsque le terrain est assez grand. Le bureau doit répondre dans les semaines qui suivent la demande et les voisins peuvent donner leur avis. D'après l'article, la hauteur des bâtiments ne peut pas dépasser huit mètres et il faut aussi la signature de deux voisins.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Die Verordnung erlaubt eine zweite Wohnung in dem Bezirk, wenn das Grundstück groß genug ist. Das Bauamt muss innerhalb von vier Wochen über den Antrag entscheiden und die Nachbarn können sich äußern. Der Antragsteller muss vor Beginn der Arbeiten einen Plan einreichen, und die Höhe der Gebäude darf sieben Meter nicht übersteigen.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. O regulamento permite uma segunda moradia na zona quando o terreno é maior. Os vizinhos podem dar a sua opinião na audiência pública e não é preciso pagar uma taxa. O requerente deve entregar uma planta na prefeitura antes do início da obra, e a altura não pode passar de seis metros.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Il regolamento permette una seconda abitazione nella zona quando il terreno è abbastanza grande, e i vicini possono dare il loro parere. Chi vuole aprire una bottega deve chiedere il permesso al comune prima che comincino i lavori.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. De verordening staat een tweede woning toe in het gebied wanneer het terrein groot genoeg is, en de buren kunnen hun mening geven. Wie wil bouwen moet eerst een vergunning bij de gemeente vragen.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Uchwała dopuszcza drugi dom na działce, jeżeli działka jest wystarczająco duża. Kto chce budować, musi najpierw uzyskać pozwolenie w urzędzie gminy, a sąsiedzi mogą zgłosić swoje uwagi.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Vyhláška dovoluje druhý dům na pozemku, pokud je pozemek dost velký. Kdo chce stavět, musí nejprve požádat úřad o povolení a sousedé se mohou vyjádřit.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap. Reglerna tillåter ett andra hus på tomten när den är tillräckligt stor. Den som vill bygga måste först söka lov hos kommunen, och grannarna får yttra sig.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. Reglerne tillader et hus mere på grunden, når den er stor nok. Den, der vil bygge, skal først søge om tilladelse hos kommunen, og naboerne kan udtale sig.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Määräys sallii toisen talon tontille, jos tontti on riittävän suuri. Rakentamiseen tarvitaan kunnan lupa, ja naapurit voivat lausua mielipiteensä.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. A rendelet megenged egy második házat a telken, ha a telek elég nagy. Aki építeni akar, annak előbb engedélyt kell kérnie a hivataltól.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Regulamentul permite o a doua casă pe teren dacă terenul este destul de mare. Cine vrea să construiască trebuie să ceară mai întâi o autorizație.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Arsa yeterince büyükse yönetmelik ikinci bir eve izin verir. İnşaata başlamadan önce belediyeden izin almak gerekir ve komşular görüş bildirebilir.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. Quy định cho phép xây căn nhà thứ hai trên lô đất nếu lô đất đủ lớn. Người muốn xây phải xin giấy phép trước.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. Peraturan itu mengizinkan rumah kedua di atas tanah jika tanahnya cukup luas. Siapa yang ingin membangun harus meminta izin lebih dahulu.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Правила разрешают второй дом на участке, если участок достаточно большой. Кто хочет строить, должен сначала получить разрешение.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Ο κανονισμός επιτρέπει δεύτερη κατοικία στο οικόπεδο.",
    "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。如果地块足够大,条例允许在该地块上建造第二栋住宅。开工前必须向办公室申请许可,邻居可以发表意见。",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。敷地が十分に広ければ、条例は二軒目の住宅を認めている。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 대지가 충분히 넓으면 조례는 두 번째 주택을 허용한다.",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. تسمح اللائحة ببناء منزل ثان إذا كانت الأرض كبيرة بما يكفي.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। यदि भूखंड बड़ा है तो दूसरा मकान बनाया जा सकता है।",
}
LANGUAGES = list(SEEDS)


def grams(word: str) -> list[int]:
    """The buckets of a word's n-grams of one to three characters, edges marked."""
    w = f" {word} "
    return [xxhash.xxh32_intdigest(w[i : i + n].encode("utf-8", "replace"), n) >> (32 - BITS) for n in (1, 2, 3) for i in range(len(w) - n + 1) if n > 1 or 0 < i < len(w) - 1]


class Languages:
    """Log-likelihoods of words by language. The table has 2**BITS rows, whatever it was adapted to."""

    def __init__(self) -> None:
        self.counts = np.zeros((1 << BITS, len(LANGUAGES)))
        for k, text in enumerate(SEEDS.values()):
            self._count(k, WORDS.findall(text.lower()))
            self._count(k, FUNCTION_WORDS.get(LANGUAGES[k], []), 2.0)
        self._settle()

    def _count(self, language: int, words: Iterable[str], weight: float = 1.0) -> None:
        for w in words:
            np.add.at(self.counts[:, language], grams(w), weight)

    def _settle(self) -> None:
        shares = self.counts / np.maximum(1.0, self.counts.sum(axis=0)) * TOTAL
        # The logarithm of a gram's share, less that of an unseen one: an unknown gram says nothing.
        self.table = (np.log(shares + SMOOTH) - np.log(SMOOTH)).astype(np.float32)
        self.known: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        """The score of a word in lower case in each language, 0 for what holds digits or a single letter of a code."""
        score = self.known.get(word)
        if score is None:
            if len(self.known) > 100_000:  # bounded memory, whatever the vocabulary
                self.known.clear()
            # Each of the three orders covers the word once.
            score = self.table[grams(word)].sum(axis=0) / 3 if word.isalpha() else np.zeros(len(LANGUAGES), np.float32)
            self.known[word] = score
        return score

    def text(self, text: str) -> np.ndarray:
        words = WORDS.findall(text.lower())
        return np.sum([self.word(w) for w in words], axis=0) if words else np.zeros(len(LANGUAGES), np.float32)

    def adapt(self, texts: list[str], least: float = 8.0) -> Languages:
        """Count the texts that are clearly in one language into it; a word counts by the square root of how often it comes."""
        seen: dict[int, dict[str, int]] = {}
        for t in texts:
            ranked = np.sort(scores := self.text(t))
            if ranked[-1] - ranked[-2] >= least:
                mine = seen.setdefault(int(scores.argmax()), {})
                for w in WORDS.findall(t.lower()):
                    mine[w] = mine.get(w, 0) + 1
        for k, words in seen.items():
            for w, n in words.items():
                self._count(k, [w], n**0.5)
        self._settle()
        return self
