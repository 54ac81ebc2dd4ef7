"""What happens to findings: redaction, marks, pseudonyms, custom terms, reviewed selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigilo.functions import rules as R
from sigilo.functions import scan
from sigilo.functions import text as T

from .spans import merge


def _fold(text: Column, spans: Column, put) -> Column:
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["ini"] - acc["at"]), put(s))
        return F.struct(kept.alias("out"), s["fim"].alias("at"))

    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, spans: DataFrame, tag: str | None = R.REDACTED) -> DataFrame:
    """(doc_id, texto): spans replaced by the tag, or by as many blocks for tag None. Overlaps are merged first; other text stays."""
    merged = merge(spans).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ini", "fim"))).alias("spans"))
    put = (lambda s: F.lit(tag)) if tag is not None else (lambda s: F.repeat(F.lit("█"), s["fim"] - s["ini"]))
    out = docs.select("doc_id", "text").join(merged, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(_fold(F.col("text"), F.col("spans"), put)).alias("texto"))


def highlight(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, texto): spans (doc_id, ini, fim, tipo) kept, within [[tipo:...]]. They must not overlap."""
    listed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ini", "fim", "tipo"))).alias("spans"))
    text = F.col("text")
    put = lambda s: F.concat(F.lit("[["), s["tipo"], F.lit(":"), F.substr(text, s["ini"] + 1, s["fim"] - s["ini"]), F.lit("]]"))
    out = docs.select("doc_id", "text").join(listed, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("spans").isNull(), text).otherwise(_fold(text, F.col("spans"), put)).alias("texto"))


# The shape of each type's stand-in (# a digit, @ a letter, % a hexadecimal digit), and our own lists that it draws from.
LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
SHAPES = {
    "TELEFONE": "(##) 9####-####", "CEP": "#####-###", "RG": "##.###.###-#", "PROC_CNJ": "#######-##.20##.8.##.####", "PASSAPORTE": "@@######",
    "PLACA_VEICULO": "@@@#@##", "CHAVE_PIX": "%%%%%%%%-%%%%-4%%%-a%%%-%%%%%%%%%%%%", "RENAVAM": "###########", "BENEFICIO_INSS": "###.###.###-#", "CNS": "7##############",
    "SIAPE": "#######", "CTPS": "#######", "PIS_PASEP": "###.#####.##-#", "TITULO_ELEITOR": "#### #### ####", "CNH": "###########", "CONTA_BANCARIA": "########-#", "AGENCIA": "####-#",
}
MALE = ["Adriano", "Bento", "Caio", "Davi", "Elias", "Fabrício", "Geraldo", "Heitor", "Ivan", "Joaquim", "Lauro", "Mateus", "Nilton", "Otávio", "Plínio", "Renan", "Saulo", "Tadeu", "Ulisses", "Vicente"]
FEMALE = ["Antônia", "Berenice", "Cecília", "Dora", "Elisa", "Francisca", "Glória", "Helena", "Irene", "Joana", "Lorena", "Marina", "Noemi", "Olívia", "Pietra", "Raquel", "Sônia", "Teresa", "Úrsula", "Yara"]
SURNAMES = ["Abreu", "Barros", "Campos", "Duarte", "Esteves", "Farias", "Guedes", "Hora", "Ipanema", "Junqueira", "Leal", "Macedo", "Neves", "Ourique", "Prado", "Queiroz", "Ramos", "Sales", "Teles", "Uchoa", "Vargas", "Xavier", "Zanetti"]
#: The federal units.
STATES = "AC AL AM AP BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RO RR RS SC SE SP TO".split()
STREETS = ["Beco", "Caminho", "Ladeira", "Largo", "Passagem", "Rua", "Vereda", "Viela"]
STREET_NAMES = ["da Garça", "do Araçá", "da Lontra", "do Jacarandá", "da Peroba", "do Sabiá", "da Graviola", "do Tamanduá", "da Jabuticaba", "do Cajueiro", "da Seriema", "do Angelim", "da Tainha", "do Buriti"]
#: Names that are kept for examples, so that no stand-in is anybody's address.
DOMAINS = ["example.com", "example.net", "example.org"]

# They decide by what a value says. First names that count as a woman's, and councils whose numbers have their name ahead.
WOMEN = [
    "maria", "ana", "juliana", "fernanda", "patricia", "camila", "adriana", "luciana", "mariana", "carolina", "beatriz", "larissa", "amanda",
    "gabriela", "renata", "vanessa", "leticia", "priscila", "claudia", "monica", "carla", "sandra", "rosa", "lucia", "cristina", "eliane", "simone",
    "sueli", "fatima", "vera", "marta", "denise", "silvia", "andrea", "fabiana", "debora", "tatiana", "aline", "bruna", "viviane", "flavia",
    "natalia", "luana", "paula", "jessica", "bianca", "sarah", "alice", "isabela", "isabella", "sofia", "valentina", "laura", "livia", "luiza",
    "vitoria", "giovanna", "rafaela", "milena", "nathalia", "thaisa", "tamires", "julia", "lidia", "helia",
]
COUNCILS = "CRM CREA CRP CRO COREN CRF CRC".split()


def feminine(name: Column) -> Column:
    return T.plain(F.lower(F.split(T.strip(name), r"\s+")[0])).isin(WOMEN)


def pseudonym(seed: Column, tipo: Column, valor: Column) -> Column:
    """A stand-in of the type's format: the same for a seed and value, valid check digits, nothing of the value in it.

    All draws come from SHA-256 of seed, value and place, so plans, tasks and engines agree. Unknown types give [TIPO_ANON].
    """

    def pick(words: list[str], i: int) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (T.contract_pick(seed, valor, i, len(words)) + 1).cast("int"))

    def number(i: int, low: int, high: int) -> Column:
        return (T.contract_pick(seed, valor, i, high - low + 1) + low).cast("string")

    def shaped(shape: str) -> Column:
        out = []
        for i, c in enumerate(shape):
            if c == "#":
                out.append(T.contract_digit(seed, valor, i).cast("string"))
            elif c == "@":
                out.append(F.substr(F.lit(LETTERS), (T.contract_pick(seed, valor, i, len(LETTERS)) + 1).cast("int"), F.lit(1)))
            elif c == "%":
                out.append(F.lower(F.hex(T.contract_pick(seed, valor, i, 16))))
            else:
                out.append(F.lit(c))
        return F.concat(*out)

    def digits(n: int) -> Column:
        return F.concat(*[T.contract_digit(seed, valor, i).cast("string") for i in range(n)])

    cpf, cnpj = T.cpf_of(digits(9)), T.cnpj_of(F.concat(digits(8), F.lit("0001")))
    day = F.date_add(F.lit("1950-01-01").cast("date"), T.contract_pick(seed, valor, 0, 22280).cast("int"))
    council = F.coalesce(*[F.when(F.contains(F.upper(valor), F.lit(c)), F.lit(c)) for c in COUNCILS], F.lit("CRM"))
    first = F.when(feminine(valor), pick(FEMALE, 0)).otherwise(pick(MALE, 0))
    out = F.when(tipo == "CPF", F.regexp_replace(cpf, r"^(...)(...)(...)", "$1.$2.$3-"))
    out = out.when(tipo == "CNPJ", F.regexp_replace(cnpj, r"^(..)(...)(...)(....)", "$1.$2.$3/$4-"))
    out = out.when(tipo.isin("PESSOA", "NOME", "PESSOA_CONTEXTO"), F.concat_ws(" ", first, pick(SURNAMES, 1), pick(SURNAMES, 2)))
    out = out.when(tipo == "EMAIL", F.concat(T.plain(F.lower(pick(MALE + FEMALE, 0))), F.lit("."), T.plain(F.lower(pick(SURNAMES, 1))), number(2, 1, 999), F.lit("@"), pick(DOMAINS, 3)))
    out = out.when(tipo == "ENDERECO", F.concat(pick(STREETS, 0), F.lit(" "), pick(STREET_NAMES, 1), F.lit(", "), number(2, 1, 9999)))
    out = out.when(tipo.isin("DATA", "DATA_NASCIMENTO"), F.when(F.contains(valor, F.lit("-")), F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy")))
    out = out.when(tipo == "OAB", F.concat(F.lit("OAB/"), pick(STATES, 0), F.lit(" "), number(1, 10000, 999999)))
    out = out.when(tipo == "REGISTRO_PROFISSIONAL", F.concat(council, F.lit("/"), pick(STATES, 0), F.lit(" "), number(1, 10000, 999999)))
    for name, shape in SHAPES.items():
        out = out.when(tipo == name, shaped(shape))
    return out.otherwise(F.concat(F.lit("["), tipo, F.lit("_ANON]")))


def mapping(findings: DataFrame, seed: str = "job_id") -> DataFrame:
    """One stand-in for each (seed, tipo, valor), made once and joined, not made again for every finding."""
    distinct = findings.select(F.col(seed).alias("job_id"), "tipo", "valor").distinct()
    return distinct.select("job_id", "tipo", F.col("valor").alias("valor_original"), pseudonym(F.col("job_id").cast("string"), F.col("tipo"), F.col("valor")).alias("valor_pseudonimo"), T.short_hash(F.col("valor")).alias("hash_original"))


def pseudonymize(docs: DataFrame, spans: DataFrame, seed: Column) -> DataFrame:
    """(doc_id, texto): spans (doc_id, tipo, valor, ini, fim) replaced by their stand-ins. They must not overlap."""
    keyed = spans.withColumn("job_id", seed)
    known = mapping(keyed).withColumnRenamed("valor_original", "valor")
    joined = keyed.join(known, ["job_id", "tipo", "valor"])
    listed = joined.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ini", "fim", "valor_pseudonimo"))).alias("spans"))
    out = docs.select("doc_id", "text").join(listed, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(_fold(F.col("text"), F.col("spans"), lambda s: s["valor_pseudonimo"])).alias("texto"))


def mapping_report(known: DataFrame) -> DataFrame:
    """tipo -> the pairs of hash and stand-in, never the value."""
    return known.groupBy("tipo").agg(F.sort_array(F.collect_list(F.struct("hash_original", "valor_pseudonimo"))).alias("itens"))


#: Terms that one pass over the texts searches; more take a pass for each so many.
TERMS = 10_000


def custom_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, termo, tipo, ini, fim) of all places of each term in each text. Blank terms fall away, tipo defaults to OUTRO.

    A term is searched once, whatever types it has; its types are joined to its places. A pass holds TERMS terms at most.
    """
    clean = terms.select(T.strip(F.col("termo")).alias("termo"), F.coalesce("tipo", F.lit("OUTRO")).alias("tipo")).where("termo <> ''").distinct()
    words = clean.select("termo").distinct()
    passes = max(1, -(-words.count() // TERMS))
    found = None
    for k in range(passes):
        held = sorted(r["termo"] for r in words.where(F.pmod(F.xxhash64("termo"), F.lit(passes)) == k).collect())  # about TERMS terms
        hits = scan.literals(docs, held).select("doc_id", F.col("valor").alias("termo"), "ini", "fim")
        found = hits if found is None else found.unionByName(hits)
    return found.join(clean, "termo").select("doc_id", "termo", "tipo", "ini", "fim")


def selected(findings: DataFrame, review: DataFrame) -> DataFrame:
    """Findings that a reviewer kept."""
    return findings.join(review.where("selected").select("job_id", "seq"), ["job_id", "seq"], "left_semi")


def stats(areas: DataFrame) -> DataFrame:
    """Counts by tipo, by page and in all, in one pass; the level says which."""
    out = areas.groupingSets([["tipo"], ["pagina"], []], "tipo", "pagina").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 1, "tipo").when(F.col("_g") == 2, "pagina").otherwise("total")
    return out.select(level.alias("nivel"), "tipo", "pagina", "n")
