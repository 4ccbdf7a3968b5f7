"""The catalogue of gate rules. Pass another list to the operators to replace it."""

from __future__ import annotations

from dataclasses import dataclass, field

BLOCK = "bloquear_positiva"
REVIEW = "requerir_revision"
BOOST = "boost"

# Strength of an effect and its label.
EFFECTS = {
    BLOCK: (3, "⛔ BLOQUEAR CONCLUSIÓN POSITIVA"),
    REVIEW: (2, "⚠️ REQUIERE ANÁLISIS DETALLADO"),
    BOOST: (1, "🔺 PRIORIDAD ELEVADA"),
}


@dataclass(frozen=True)
class GateRule:
    """Active iff every term occurs in the question and no exception does."""

    rule_id: str
    terms: list[str]
    forced: list[str]
    effect: str = REVIEW
    exceptions: list[str] = field(default_factory=list)


# Terms, exceptions, forced documents and effects.
GATE_RULES = [
    GateRule("conjunto-armonico-recepcion", ["conjunto armónico", "recepción"], ["DDU-161", "CGR-8518-2006"], BLOCK,
             ["sin recepción", "no recepcionada", "previo a la recepción"]),
    GateRule("loteo-rural-art55", ["zona rural", "subdivid"], ["LGUC"]),
    GateRule("ddu-490-derogada", ["ddu 490"], ["DDU-519", "CGR-E14360-2025"], REVIEW,
             ["antes de la ddu 519", "histórica", "derogada"]),
    GateRule("modificacion-obra-recepcionada", ["ampliación", "recepción"], ["OGUC"], REVIEW, ["sin recepción"]),
    GateRule("cambio-uso-suelo-rural", ["cambio de uso", "rural"], ["LGUC"]),
    GateRule("borde-costero-concesion", ["borde costero"], ["LGUC"], REVIEW,
             ["dentro del predio", "alejado del borde"]),
    GateRule("zona-tipica-intervencion", ["zona típica"], ["LEY-17288"]),
    GateRule("monumento-historico-intervencion", ["monumento histórico"], ["LEY-17288"]),
    GateRule("eia-seia-obligatorio", ["impacto ambiental", "permiso"], ["LEY-19300"], REVIEW,
             ["ya tiene rca", "con rca", "rca aprobada"]),
    GateRule("regularizacion-sin-planos", ["regularizar", "sin permiso"], ["OGUC"]),
    GateRule("servidumbre-medianero", ["medianero", "deslinde"], ["OGUC"]),
    GateRule("obras-en-copropiedad", ["condominio", "obra"], ["LEY-21442"], REVIEW,
             ["bien exclusivo", "propiedad exclusiva"]),
    GateRule("zona-inundacion-caudalosa", ["inundación", "permiso"], ["LGUC"]),
    GateRule("area-verde-publica", ["área verde", "construir"], ["LGUC"], BLOCK,
             ["ceñido a la norma", "infraestructura permitida"]),
    GateRule("bien-nacional-uso-publico", ["plaza", "instalar"], ["LGUC"], BLOCK,
             ["contiguo a la plaza", "frente a la plaza"]),
    GateRule("permiso-demolicion-previo", ["demoler", "construir"], ["OGUC"], REVIEW,
             ["ya demolido", "sitio eriazo", "terreno limpio"]),
    GateRule("cip-antes-del-permiso", ["certificado de informaciones previas"], ["LGUC", "OGUC"]),
    GateRule("servidumbre-electrica", ["tendido eléctrico", "construir"], ["DFL-4"]),
]
