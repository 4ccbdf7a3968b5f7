"""The pattern tables of the taggers. Order matters; the first match wins."""

# Regulated areas a question may cross into.
# (area, authority, probable norm, patterns in order)
CROSSING_AREAS = [
    ("Medioambiente", "SEA / SEREMI del Medio Ambiente", "Ley N°19.300 (LGBMA), DS 40/2012", [
        r"impacto ambiental|evaluaci[oó]n ambiental|rca\b|sea\b|conama",
        r"\bhumedal|zona de amortiguaci[oó]n|flora.*nativa|fauna.*protegida",
        r"contaminaci[oó]n del suelo|pasivo ambiental|remediaci[oó]n",
        r"declaraci[oó]n de impacto|estudio de impacto",
    ]),
    ("Patrimonio", "Consejo de Monumentos Nacionales (CMN)", "Ley N°17.288 de Monumentos Nacionales", [
        r"monument[oa] nacional|zona t[íi]pica|bien nacional protegido",
        r"\bcmn\b|consejo de monumentos",
        r"patrimon[io]+|edificio hist[oó]rico|inmueble de conservaci[oó]n",
        r"zona de conservaci[oó]n hist[oó]rica",
    ]),
    ("Salud", "SEREMI de Salud / MINSAL", "Código Sanitario, DS 594/1999, DS 78/2009", [
        r"sanitari[oa]|seremi.*salud|autorización sanitaria",
        r"residuo(s)? (peligros|tóxic|hospitalari)",
        r"efluente(s)?|aguas servidas|planta de tratamiento",
        r"ruido(s)? moles(to|tia)|contaminaci[oó]n ac[uú]stica",
        r"higiene.*ambient|salud.*ambient",
    ]),
    ("Infraestructura vial", "MOP / SERVIU / Municipalidad", "DFL MOP N°850/1997, Ley de Caminos", [
        r"camino p[uú]blico|faja vial|derecho de v[ií]a",
        r"\bmop\b|direcci[oó]n de vialidad",
        r"autopista|carretera|ruta nacional",
        r"acceso vial|ingreso vehicular.*ruta",
    ]),
    ("Aguas", "DGA (Dirección General de Aguas)", "Código de Aguas (DFL N°1.122/1981)", [
        r"\bdga\b|direcci[oó]n general de aguas",
        r"derechos de agua|aprovechamiento de aguas",
        r"cauce|ribera|[aá]lv[ae]o|lecho del r[ií]o",
        r"inundaci[oó]n|zona de inundaci[oó]n|cota de inundaci[oó]n",
        r"napa fre[aá]tica|aguas subterr[aá]neas",
    ]),
    ("Electricidad y telecomunicaciones", "SEC / CNE / Subsecretaría de Telecomunicaciones",
     "DFL N°4/2006 (Ley Eléctrica General), Ley N°18.168", [
        r"\bsec\b|superintendencia de electricidad",
        r"tendido el[eé]ctrico|l[ií]nea de alta tensi[oó]n|subestaci[oó]n",
        r"antena(s)?.*telecomunicacion|torre.*celular|radiobase",
        r"energia solar|paneles fotovolt|generaci[oó]n distribuida",
    ]),
    ("Defensa Nacional", "Ministerio de Defensa / DGAC / Armada", "DFL N°221/1978, Ley N°16.752", [
        r"zona de seguridad nacional|zona de frontera",
        r"\bdgac\b|aeron[aá]utica civil|servidumbre aeron[aá]utica",
        r"cono de aproximaci[oó]n|altura m[aá]xima.*aeropuerto",
        r"\barmada\b.*zona|borde costero.*defensa",
    ]),
    ("Bienes Nacionales", "Ministerio de Bienes Nacionales / CONAF", "DL N°1.939/1977, Ley N°18.362", [
        r"bien nacional de uso p[uú]blico|bienes fiscales",
        r"\bconaf\b|parque nacional|reserva nacional",
        r"concesi[oó]n marit[íi]ma|borde costero|playa.*acceso",
        r"glaciar|campo de hielo",
    ]),
]

# Topics outside the subject. "sri|sii" has no word boundary on purpose.
OUT_OF_DOMAIN = [
    r"impuesto|tributari|sri|sii",
    r"receta|cocina|aliment",
    r"medicina|enfermedad|tratamiento médico",
    r"código civil|código penal|código laboral",
    r"\bsueldo\b|\bsalario\b|\bcontrato laboral\b",
]

# Requested action.
ACTIONS = [
    ("acoger_conjunto_armonico", r"acoger.{0,40}conjunto\s+arm[oó]nico|conjunto\s+arm[oó]nico.{0,40}acoger"),
    ("subdividir", r"\bsubdivid[ir]+\b|\bsubdivisi[oó]n\b"),
    ("lotear", r"\blotear\b|\bloteo\b"),
    ("ampliar", r"\bampliar\b|\bampliaci[oó]n\b"),
    ("cambiar_destino", r"\bcambio\s+de\s+destino\b|\bcambiar\s+(?:el\s+)?destino\b"),
    ("cambiar_uso_suelo", r"\bcambio\s+de\s+uso\s+(?:de\s+)?suelo\b|\bcambiar\s+uso\s+(?:de\s+)?suelo\b"),
    ("regularizar", r"\bregularizar\b|\bregularizaci[oó]n\b"),
    ("modificar_permiso", r"\bmodificar.{0,30}permiso\b|\bmodificaci[oó]n.{0,30}permiso\b"),
    ("desistir_permiso", r"\bdesistir.{0,30}permiso\b"),
    ("obtener_recepcion", r"\bobtener.{0,30}recepci[oó]n\b|\bsolicitar.{0,30}recepci[oó]n\b"),
    ("construir_nuevo", r"\bconstruir\b|\bnueva\s+construcci[oó]n\b|\bnuevo\s+edificio\b"),
]

# State of the works.
WORK_STATUS = [
    ("con_recepcion", r"\brecepci[oó]n\s+definitiva\b|\bya\s+(?:tiene|cuenta\s+con)\s+recepci[oó]n\b"
                      r"|\bobra\s+recepcionada\b|\bcon\s+recepci[oó]n\b"),
    ("irregular", r"\bsin\s+permiso\b|\birregular\b|\bno\s+cuenta\s+con\s+permiso\b|\bobra\s+irregular\b"),
    ("sin_recepcion", r"\bsin\s+recepci[oó]n\b|\baún\s+no\s+(?:tiene|ha\s+obtenido)\s+recepci[oó]n\b"),
    ("con_permiso_vigente", r"\bcon\s+permiso\s+(?:de\s+edificaci[oó]n\s+)?(?:vigente|aprobado)\b|\btiene\s+permiso\b"),
]

# Kind of zone.
ZONES = [
    ("rural_agricola", r"\bzona\s+rural\s+agr[ií]cola\b|\bsuelo\s+agr[ií]cola\b|\bagrícola\b.*\bzona\s+rural\b"),
    ("rural", r"\bzona\s+rural\b|\bterreno\s+rural\b|\bfuera\s+del\s+l[ií]mite\s+urbano\b|\bsuelo\s+rural\b"),
    ("zona_tipica", r"\bzona\s+t[íi]pica\b|\bzona\s+pintoresca\b"),
    ("borde_costero", r"\bborde\s+costero\b|\bzona\s+costera\b"),
    ("zona_fronteriza", r"\bzona\s+fronteriza\b|\bcomplejo\s+fronterizo\b"),
    ("urbana", r"\bzona\s+urbana\b|\bsuelo\s+urbano\b|\bdentro\s+del\s+l[ií]mite\s+urbano\b"),
]

# Norm named in a question, and wording that asks whether something is allowed.
NAMED_NORM = (r"\b(DDU\s*[-–]?\s*\d+|LGUC|OGUC|Art\.\s*\d+|DS[-–\s]?\d+|DFL[-–\s]?\d+"
              r"|Ley\s+\d+[\.\d]*|Circular\s+DDU\s*\d+)")
ASKS_PERMISSION = (r"\bpuedo\b|\bse\s+puede\b|\bes\s+posible\b|\bprocede\b|\bfactible\b"
                   r"|\bes\s+v[aá]lido\b|\bpermitido\b")

# Actions that change works already received.
ACTIONS_ON_RECEIVED_WORKS = ["ampliar", "acoger_conjunto_armonico", "modificar_permiso"]

# Restrictive wording of a passage.
RESTRICTIVE = [
    r"\bno\s+procede\b",
    r"\bimprocedencia\b",
    r"\bimprocedente\b",
    r"\bno\s+es\s+posible\b",
    r"\bno\s+puede\s+acogerse\b",
    r"\bno\s+podr[aá]\b",
    r"\bse\s+excluye\b",
    r"\bquedar[aá]\s+prohibid[oa]\b",
    r"\bprohibici[oó]n\b",
    r"\bno\s+se\s+permitir[aá]\b",
    r"\bdeja\s+sin\s+efecto\b",
    r"\bderogad[oa]\b",
    r"\bcontravien[ea]\b",
    r"\bdesplaza\s+la\s+norma\b",
]

# Wording of an exception.
EXCEPTIONS = [
    r"\bsalvo\b.{0,80}\b(que|cuando|si)\b",
    r"\bexcepto\b",
    r"\bsin\s+perjuicio\s+de\b",
    r"\ba\s+menos\s+que\b",
]

# Affirmative conclusions of an answer.
PERMISSIVE = [
    r"\bsí[,]?\s+es\s+posible\b",
    r"\bsí[,]?\s+puede\b",
    r"\bsí[,]?\s+procede\b",
    r"\bsí[,]?\s+se\s+puede\b",
    r"\bsí[,]?\s+es\s+factible\b",
    r"\bno\s+existe\s+impedimento\b",
    r"\bno\s+hay\s+impedimento\b",
]

# Terms that make a question worth an exact full-text search.
EXACT_TERMS = [
    r"art[íi]culo[s]?\s+\d+",
    r"\bart\.\s*\d+",
    r"\b(DDU|LGUC|OGUC|DS|DFL|DL|Ley|Circular|Resolución|Res|Decreto)\s*[-–]?\s*\d+",
    r"\bN[°º]\s*\d+",
]

# Article and circular references, and the numbers beyond which they cannot exist.
REF_ARTICLE = r"Art(?:[íi]culo)?s?\s*\.?\s*(\d+)"
REF_CIRCULAR = r"DDU[- ]?(?:N[°º]?\s*)?(\d+)"
REF_ANY = r"Art(?:[íi]culo)?s?\s*\.?\s*\d+|DDU[- ]?(?:N[°º]?\s*)?\d+"
MENTIONS_LAW_CODE = r"LGUC|DFL.?458"
MAX_ARTICLE = 999
MAX_ARTICLE_LAW_CODE = 200
MAX_CIRCULAR = 600

# Error texts worth another attempt, and those that mean a quota is used up.
TRANSIENT_ERRORS = ["límite", "503", "429", "413", "TPM", "parse stream", "Failed to parse",
                    "alta demanda", "overloaded", "too large"]
QUOTA_ERRORS = ["429", "quota", "rate limit", "too many requests", "Please retry"]

# References between documents.
REF_NORM = r"(LGUC|OGUC|DDU|DS|DFL|DL|LEY|Ley)\s*[-–]?\s*N[°o]?\s*(\d[\d.]*[\w]*)"
REF_LAW = r"Ley\s+N[°o]\s*([\d.]+)"

# Articles cited in an answer.
CITED_FOR_CHECK = r"\b(?:art[íi]culo|art\.)\s*([\d.]+[°º]?)"
CITED_LONG = r"art[íi]culo[s]?\s+(\d+\s*(?:bis|ter|qu[aá]ter|quinquies)?)\s*[°º]?"
CITED_SHORT = r"\bart\.\s*(\d+\s*(?:bis|ter|qu[aá]ter|quinquies)?)\s*[°º]?"

# Phrases of which one must be in an answer.
DISCLAIMERS = ["Aviso legal", "asesoría jurídica", "profesional habilitado"]
