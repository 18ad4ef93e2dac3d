"""Lexicons of authors and popes: our own, short and plain; a deployment adds its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Authors, with forms of their names and titles of works, folded; any form tells the author.
AUTHORS = {
    "Clement of Rome": (("clement of rome", "clemente de roma", "clemente romano"), ("first epistle to the corinthians",)),
    "Ignatius of Antioch": (("ignatius of antioch", "inacio de antioquia"), ("epistle to the smyrnaeans",)),
    "Polycarp": (("polycarp", "policarpo"), ("martyrdom of polycarp",)),
    "Justin Martyr": (("justin martyr", "justino martir", "iustinus martyr"), ("dialogue with trypho", "dialogo com trifao")),
    "Irenaeus": (("irenaeus", "irineu de liao", "ireneu de liao"), ("against heresies", "adversus haereses", "contra as heresias")),
    "Clement of Alexandria": (("clement of alexandria", "clemente de alexandria"), ("stromata", "paedagogus", "protrepticus")),
    "Tertullian": (("tertullian", "tertuliano"), ("apologeticus", "de praescriptione")),
    "Origen": (("origen", "origenes"), ("de principiis", "contra celsum")),
    "Cyprian": (("cyprian", "cipriano"), ("de unitate ecclesiae", "de lapsis")),
    "Eusebius": (("eusebius", "eusebio de cesareia"), ("historia ecclesiastica", "praeparatio evangelica")),
    "Athanasius": (("athanasius", "atanasio"), ("de incarnatione", "life of antony", "vida de antao")),
    "Hilary of Poitiers": (("hilary of poitiers", "hilario de poitiers"), ("de synodis",)),
    "Ephrem": (("ephrem", "ephraem", "efrem"), ("hymns on paradise",)),
    "Basil": (("basil the great", "basil of caesarea", "basilio magno", "basilio de cesareia"), ("hexaemeron", "de spiritu sancto")),
    "Gregory of Nazianzus": (("gregory of nazianzus", "gregorio de nazianzo", "gregorio nazianzeno"), ("theological orations",)),
    "Gregory of Nyssa": (("gregory of nyssa", "gregorio de nissa"), ("life of moses", "vida de moises")),
    "Cyril of Jerusalem": (("cyril of jerusalem", "cirilo de jerusalem"), ("catechetical lectures", "catequeses")),
    "Ambrose": (("ambrose", "ambrosio de milao", "ambrosius"), ("de officiis", "de mysteriis")),
    "John Chrysostom": (("chrysostom", "crisostomo"), ("on the priesthood", "de sacerdotio")),
    "Jerome": (("jerome", "hieronymus", "jeronimo"), ("de viris illustribus", "adversus jovinianum")),
    "Augustine": (("augustine", "augustinus", "agostinho"), ("confessiones", "confissoes", "de trinitate", "de civitate dei", "cidade de deus")),
    "Cyril of Alexandria": (("cyril of alexandria", "cirilo de alexandria"), ("against nestorius",)),
    "Leo the Great": (("leo the great", "leao magno"), ("tome of leo",)),
    "Vincent of Lerins": (("vincent of lerins", "vicente de lerins"), ("commonitorium",)),
    "Benedict": (("benedict of nursia", "bento de nursia"), ("regula benedicti", "regra de sao bento")),
    "Gregory the Great": (("gregory the great", "gregorio magno"), ("moralia in job", "regula pastoralis")),
    "Isidore": (("isidore of seville", "isidoro de sevilha"), ("etymologiae", "etimologias")),
    "Maximus the Confessor": (("maximus the confessor", "maximo o confessor"), ("ambigua",)),
    "Bede": (("bede", "beda"), ("ecclesiastical history of the english",)),
    "John of Damascus": (("john of damascus", "john damascene", "joao damasceno"), ("de fide orthodoxa", "fount of knowledge")),
    "Anselm": (("anselm", "anselmo"), ("proslogion", "cur deus homo")),
    "Bernard of Clairvaux": (("bernard of clairvaux", "bernardo de claraval"), ("de diligendo deo",)),
    "Thomas Aquinas": (("thomas aquinas", "tomas de aquino", "aquinas"), ("summa theologiae", "suma teologica", "summa contra gentiles")),
    "Bonaventure": (("bonaventure", "boaventura"), ("itinerarium mentis",)),
}

#: Names of popes, with their folded forms; the numeral is read from the text. Compound names go first.
POPES = {
    "John Paul": ("john paul", "joao paulo", "ioannes paulus"), "Leo": ("leo", "leao"), "Pius": ("pius", "pio"), "Gregory": ("gregory", "gregorio", "gregorius"),
    "Benedict": ("benedict", "bento", "benedictus"), "John": ("john", "joao", "ioannes"), "Paul": ("paul", "paulo", "paulus"), "Clement": ("clement", "clemente", "clemens"),
    "Innocent": ("innocent", "inocencio", "innocentius"), "Boniface": ("boniface", "bonifacio", "bonifatius"), "Urban": ("urban", "urbano", "urbanus"),
    "Alexander": ("alexander", "alexandre"), "Celestine": ("celestine", "celestino"), "Sixtus": ("sixtus", "sisto", "xisto"), "Nicholas": ("nicholas", "nicolau"),
    "Eugene": ("eugene", "eugenio"), "Martin": ("martin", "martinho"), "Julius": ("julius", "julio"), "Stephen": ("stephen", "estevao"), "Adrian": ("adrian", "adriano"),
    "Honorius": ("honorius", "honorio"), "Callixtus": ("callixtus", "calisto"), "Paschal": ("paschal", "pascoal"), "Lucius": ("lucius", "lucio"),
}


def known_authors(spark: SparkSession, authors: dict = AUTHORS) -> DataFrame:
    """SRC17: author, ordinal, pattern, weight: a row for each form, names with weight 2 and works with 1. Patterns are regular
    expressions on folded text; the table is as small as the lexicon."""
    rows, ordinal = [], 0
    for author, (names, works) in authors.items():
        for forms, weight in ((names, 2), (works, 1)):
            for form in forms:
                rows.append((author, ordinal, rf"\b{form}\b", weight))
                ordinal += 1
    return spark.createDataFrame(rows, "author string, ordinal int, pattern string, weight int")
