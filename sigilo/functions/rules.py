"""The catalogue of detection rules, in the dialect of java.util.regex: (?U) makes classes and case Unicode-aware."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    tipo: str
    pattern: str
    ignore_case: bool

    @property
    def java(self) -> str:
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern


# Types, patterns and word lists that results must agree on.
NUMBER = r"(?:n[º°]?\.?\s*)?"
RULES = [
    Rule("CPF", r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", False),
    Rule("CNPJ", r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", False),
    Rule("PROC_CNJ", r"\b\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b", False),
    Rule("OAB", r"\bOAB[ /-]?(?:[A-Z]{2})?[ .]?\d{1,7}[A-Z]?\b", True),
    Rule("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", False),
    Rule("TELEFONE", r"(?:\+?55[\s-]?)?(?:\(?\d{2}\)?[\s-])(?:9\d{4}|\d{4})[-.\s]?\d{4}\b", False),
    Rule("CEP", r"(?:CEP|C\.E\.P\.?)\s*[:.]?\s*(\d{2}\.?\d{3}-?\d{3})", True),
    Rule("RG", r"(?:R\.?G\.?|C\.?I\.?|Identidade|Registro\s+Geral)\s*[:º]?\s*([\w\d\.-]+)", True),
    Rule("PASSAPORTE", r"(?:Passaporte|Pass\.?)\s*[:.]?\s*([A-Z]{1,2}\d{6,7})\b", True),
    Rule("DATA_NASCIMENTO", r"(?:nascido|nascida|nasc\.?|data\s+de\s+nascimento|DN)\s*[:.]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", True),
    Rule("ENDERECO", r"(?:Rua|Av\.?|Avenida|Alameda|Travessa|Praça|Rodovia|Estrada|Viela|Largo|Quadra|BR-\d+)\s+[A-Za-zÀ-ÿ0-9\s]+,?\s*" + NUMBER + r"\d+(?:\s*,?\s*(?:Apto?\.?|Ap\.?|Bloco?\.?|Bl\.?|Casa|Sala|Loja|Conjunto|Cj\.?)\s*[\w\d-]+)?", True),
    Rule("CTPS", r"(?:CTPS|Carteira\s+de\s+Trabalho(?:\s+e\s+Previdência\s+Social)?)\s*[:.]?\s*" + NUMBER + r"(\d{5,8})", True),
    Rule("PIS_PASEP", r"(?:PIS|PASEP|NIS|NIT)\s*[:.]?\s*(\d{3}\.?\d{5}\.?\d{2}-?\d)", True),
    Rule("TITULO_ELEITOR", r"(?:Título\s+(?:de\s+)?Eleitor|T\.?\s*E\.?)\s*[:.]?\s*(\d{4}\s?\d{4}\s?\d{4})", True),
    Rule("CNH", r"(?:CNH|Carteira\s+(?:Nacional\s+)?(?:de\s+)?Habilitação|Permissão\s+para\s+Dirigir)\s*[:.]?\s*" + NUMBER + r"(\d{9,11})", True),
    Rule("RENAVAM", r"(?:RENAVAM)\s*[:.]?\s*(\d{9,11})", True),
    Rule("PLACA_VEICULO", r"\b(?:placa|veículo|veículo\s+de\s+placa|placa\s+de\s+prefixo)?\s*([A-Z]{3}[-\s]?(?:\d{4}|\d[A-Z]\d{2}))\b", True),
    Rule("CONTA_BANCARIA", r"(?:Conta|C/?C|Conta\s+Corrente|Conta\s+Poupança|Poupança)\s*(?:n[º°]?\.?)?\s*[:.]?\s*(\d{4,12}[-.]?\d{0,2})", True),
    Rule("AGENCIA", r"(?:Agência|Ag\.?)\s*(?:n[º°]?\.?)?\s*[:.]?\s*(\d{3,5}[-.]?\d?)", True),
    Rule("CHAVE_PIX", r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", True),
    Rule("BENEFICIO_INSS", r"(?:benefício|beneficio|NB|nb|n\.?\s*b\.?)\s*[:.]?\s*(\d{3}\.?\d{3}\.?\d{3}-?\d)", True),
    Rule("CNS", r"(?:CNS|Cartão\s+(?:Nacional\s+de\s+)?Saúde|SUS)\s*[:.]?\s*([12789]\d{14})", True),
    Rule("SIAPE", r"(?:SIAPE|matrícula\s+SIAPE|mat\.?\s*SIAPE)\s*[:.]?\s*(\d{7})", True),
    Rule("REGISTRO_PROFISSIONAL", r"\b(CRM|CREA|CRP|CRO|COREN|CRF|CRC|CREFITO|CFM)[ /-]?(?:[A-Z]{2})?[ .]?\d{3,8}[A-Z]?\b", True),
    Rule(
        "PESSOA_CONTEXTO",
        r"(?:Autor(?:a)?|Réu|Ré|Requerente|Requerido(?:a)?|Indiciado(?:a)?|Vítima|Investigado(?:a)?|Apelante|Apelado(?:a)?|Agravante|"
        r"Agravado(?:a)?|Impetrante|Impetrado(?:a)?|Reclamante|Reclamado(?:a)?|Exequente|Executado(?:a)?|Paciente|Denunciado(?:a)?|"
        r"Querelante|Querelado(?:a)?|Testemunha|Depoente|Informante|Fiador(?:a)?|Avalista|Devedor(?:a)?|Credor(?:a)?|Herdeiro(?:a)?|"
        r"Inventariante|Espólio\s+de|Terceiro(?:a)?(?:\s+Interessado(?:a)?)?|(?:Menor|Criança|Adolescente)|"
        r"(?:Sr\.?|Sra\.?|Dr\.?|Dra\.?|Me\.?|Des\.?|Min\.?)|Nome(?:\s+completo)?|Genitor(?:a)?|Pai|Mãe|Filho(?:a)?|Cônjuge|Companheiro(?:a)?)"
        r"\s*[:.]?\s*([A-ZÀ-Ú][a-zà-ú]+(?:\s+(?:d[aoe]s?|e|D[aoe]s?)\s+)?(?:\s+[A-ZÀ-Ú][a-zà-ú]+){1,6})",
        False,
    ),
]
#: The same types with the known slips mended: whole numbers, word limits, connectives within names.
MENDED = {
    "OAB": Rule("OAB", r"\bOAB[ /-]?(?:[A-Z]{2})?[ .]?\d{1,3}(?:\.?\d{3})*[A-Z]?\b", True),
    "RG": Rule("RG", r"\b(?:R\.?G\.?|C\.?I\.?|Identidade|Registro\s+Geral)(?!\w)\s*[:º]?\s*([\w.-]*\d[\w.-]*)", True),
    "PLACA_VEICULO": Rule("PLACA_VEICULO", r"\b([A-Z]{3}[-\s]?(?:\d{4}|\d[A-Z]\d{2}))\b", False),
    "REGISTRO_PROFISSIONAL": Rule("REGISTRO_PROFISSIONAL", r"\b((?:CRM|CREA|CRP|CRO|COREN|CRF|CRC|CREFITO|CFM)[ /-]?(?:[A-Z]{2})?[ .]?\d{3,8}[A-Z]?)\b", True),
    "PESSOA_CONTEXTO": Rule(
        "PESSOA_CONTEXTO",
        r"(?:Autor(?:a)?|Réu|Ré|Requerente|Requerido(?:a)?|Indiciado(?:a)?|Vítima|Investigado(?:a)?|Apelante|Apelado(?:a)?|Agravante|"
        r"Agravado(?:a)?|Impetrante|Impetrado(?:a)?|Reclamante|Reclamado(?:a)?|Exequente|Executado(?:a)?|Paciente|Denunciado(?:a)?|"
        r"Querelante|Querelado(?:a)?|Testemunha|Depoente|Informante|Fiador(?:a)?|Avalista|Devedor(?:a)?|Credor(?:a)?|Herdeiro(?:a)?|"
        r"Inventariante|Espólio\s+de|Terceiro(?:a)?(?:\s+Interessado(?:a)?)?|(?:Menor|Criança|Adolescente)|"
        r"(?:Sr\.?|Sra\.?|Dr\.?|Dra\.?|Me\.?|Des\.?|Min\.?)|Nome(?:\s+completo)?|Genitor(?:a)?|Pai|Mãe|Filho(?:a)?|Cônjuge|Companheiro(?:a)?)"
        r"\s*[:.]?\s*([A-ZÀ-Ú][a-zà-ú]+(?:\s+(?:(?:d[aoe]s?|e|D[aoe]s?)\s+)?[A-ZÀ-Ú][a-zà-ú]+){1,6})",
        False,
    ),
}
#: What keeps a scan linear (`scan.Pattern`): pivot and what stands ahead of it, or the reach in which the digit must be.
LINEAR = {
    "EMAIL": ("@", r"[A-Za-z0-9._%+-]", None),
    "ENDERECO": (None, None, (r"(?:Rua|Av\.?|Avenida|Alameda|Travessa|Praça|Rodovia|Estrada|Viela|Largo|Quadra|BR-\d+)\s+", r"[A-Za-zÀ-ÿ0-9\s]*", r"[,.nº°\s]*")),
}
PUBLIC_BEFORE = (
    r"(?iU)(?:Juiz|Juíza|Desembargador|Desembargadora|Escrivã|Escrivão|Promotor|Promotora|Defensor|Defensora|Advogado|Advogada|Dr\.|Dra\.|"
    r"Perito|Perita|Conciliador|Conciliadora|Magistrado|Magistrada|Exmo\.?\s*Sr\.?|Exma\.?\s*Sra\.?|MM\.?\s*Juiz|"
    r"Relator|Relatora|Revisor|Revisora|Vogal)\s*(?:de Direito|Substituto|Federal|Titular)?"
)
PRIVATE_BEFORE = (
    r"(?iU)(?:Autor|Autora|Réu|Ré|Requerente|Requerido|Requerida|Vítima|Testemunha|Depoente|Agravante|Agravado|Agravada|Impetrante|Impetrado|"
    r"Exequente|Executado|Reclamante|Reclamado|Apelante|Apelado|Embargante|Embargado|Querelante|Querelado)\s*:?"
)
PUBLIC_AFTER = (
    r"(?iU)(?:,\s*)?(?:juiz|juíza|desembargador|desembargadora|magistrado|magistrada|promotor|promotora|defensor|defensora|procurador|procuradora|"
    r"advogado|advogada|perito|perita|escrivão|escrivã|relator|relatora|revisor|revisora|presidente|vice-presidente)"
)
QUALIFIED_AFTER = (
    r"(?iU)(?:,\s*)?(?:OAB[/-]?[A-Z]{2}[/-]?\d+|matrícula\s*n?\.?\s*\d+|inscrito\s*na\s*OAB|membro\s*d[oa]\s*(?:MP|Ministério Público|Defensoria)|"
    r"titular\s*d[ao]?\s*\d+[ªºa]?\s*(?:Vara|Câmara|Turma))"
)
PRIVATE_AFTER = (
    r"(?iU)(?:,\s*)?(?:autor[a]?\s*d[ao]|réu|ré\s*d[ao]|requerente|requerido|vítima\s*d[ao]|parte\s*(?:autora|ré|requerente)|"
    r"testemunha\s*d[ao]|qualificad[oa]\s*nos\s*autos)"
)
PUBLIC_BODIES = [
    "ESTADO", "UNIÃO", "MUNICÍPIO", "MUNICIPIO", "MINISTÉRIO", "MINISTERIO", "TRIBUNAL", "DEFENSORIA", "POLÍCIA", "POLICIA", "PREFEITURA", "GOVERNO",
    "CÂMARA", "CAMARA", "ASSEMBLEIA", "SENADO", "CONGRESSO", "PODER JUDICIÁRIO", "PODER LEGISLATIVO", "RECEITA FEDERAL", "INSS",
]
HEADER_COMPAT = [r"(?iU)(?:Autor|Requerente|Impetrante|Exequente|Agravante)es?\s*[:.]\s*([^\n]+)", r"(?iU)(?:Réu|Ré|Requerido|Impetrado|Executado|Agravado)s?\s*[:.]\s*([^\n]+)"]
HEADER = [r"(?iU)(?:Autor(?:a|es|as)?|Requerentes?|Impetrantes?|Exequentes?|Agravantes?)\s*[:.]\s*([^\n]+)", HEADER_COMPAT[1]]
TOPICS = [
    "doença", "diagnóstico", "tratamento", "medicamento", "hospital", "psiquiátrico", "psicológico", "depressão", "ansiedade", "câncer", "hiv", "aids", "tuberculose", "diabetes", "internação",
    "menor", "criança", "adolescente", "infância", "abuso", "violência", "agressão", "estupro", "assédio", "adoção", "guarda", "pensão", "divórcio", "separação",
]
NAME = r"\s*[:]\s*([A-ZÀ-Ú][a-zà-ú]+(?:\s+[A-ZÀ-Ú][a-zà-ú]+){1,5})"
HINTS = [
    "(?:Autor|Autora|Requerente|Reclamante|Impetrante|Apelante|Agravante)" + NAME,
    "(?:Réu|Ré|Requerido|Requerida|Reclamado|Reclamada|Impetrado|Apelado|Agravado)" + NAME,
    "(?:Vítima|Ofendido|Ofendida|Paciente|Interessado|Interessada)" + NAME,
]
ENTITY_TYPES = [r.tipo for r in RULES] + ["PESSOA", "ORGANIZACAO", "OUTRO", "ROSTO", "ASSINATURA"]
REDACTED = "[ANONIMIZADO]"


def rules(compat: bool = False) -> list[Rule]:
    """All rules in their order. compat keeps the slips of the catalogue, the default mends them."""
    return RULES if compat else [MENDED.get(r.tipo, r) for r in RULES]


def rule(tipo: str, compat: bool = False) -> Rule:
    for r in rules(compat):
        if r.tipo == tipo:
            return r
    raise ValueError(f"no rule of type {tipo}")
