"""Classes, elements and radii of atoms, as Columns over names; the tables are fixed values of the formats and the papers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Residue names by class. What is in none of them is a ligand.
PROTEIN = (
    "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL ASH CYM CYX GLH HID HIE HIP HSD HSE HSP LYN MSE"
).split()
DNA = "DA DC DG DT DI DA3 DA5 DC3 DC5 DG3 DG5 DT3 DT5".split()
RNA = "A C G U I A3 A5 C3 C5 G3 G5 U3 U5".split()
WATER = "SOL HOH WAT H2O TIP3 TIP3P TIP4 TIP4P SPC SPCE".split()
IONS = (
    "NA K CA MG MN FE CO NI CU ZN CD HG PB CL BR I SO4 PO4 C2H3O2 NO3 NH4 H3O MOO4 SEO4 VO4 WO4 NA+ K+ CA2 CA2+ MG2 MG2+ ZN2 ZN2+ CL- SOD POT CLA"
).split()
#: The residues that count as solvent where a network is bounded.
SOLVENT_IONS = (
    "LI NA NA+ SOD K K+ POT RB CS MG MG2 MG2+ CA CA2 CA2+ SR BA ZN ZN2 ZN2+ CD FE FE2 FE3 MN CU CU1 CU2 CO NI AL F CL CL- BR I IOD SO4 PO4 NH4 CLA ION OUT MN2"
).split()
#: Names of categories that a user may give.
CATEGORIES = {
    "protein": "protein proteins prot", "dna": "dna deoxyribonucleic deoxyribonucleic_acid", "rna": "rna ribonucleic ribonucleic_acid",
    "water": "water waters sol solvent", "ions": "ion ions", "ligand": "ligand ligands lig other others unknown nonstandard",
}

#: Fixed values of the united-atom radii: aliphatic and trigonal carbon, neutral and charged nitrogen, oxygen, sulphur, other.
ALIPHATIC, TRIGONAL, NEUTRAL, CHARGED, OXYGEN, SULPHUR, OTHER, PROBE = 1.87, 1.76, 1.65, 1.5, 1.4, 1.85, 2.0, 1.4
#: Side-chain atoms of the amino acids, and which carbons and nitrogens are trigonal and charged.
SIDE_CHAINS = {
    "ALA": "CB OC1 OC2", "ARG": "CB CG CD NE CZ NH1 NH2", "ASN": "CB CG OD1 ND2", "ASP": "CB CG OD1 OD2", "CYS": "CB SG S", "GLN": "CB CG CD OE1 NE2",
    "GLU": "CB CG CD OE1 OE2", "GLY": "OC1 OC2", "HIS": "CB CG ND1 CD2 CE1 NE2", "ILE": "CB CG1 CG2 CD CD1", "LEU": "CB CG CD1 CD2", "LYS": "CB CG CD CE NZ",
    "MET": "CB CG SD S CE", "PHE": "CB CG CD1 CD2 CE1 CE2 CZ", "PRO": "CB CG CD", "SER": "CB OG", "THR": "CB OG1 OG CG2",
    "TRP": "CB CG CD1 CD2 NE1 CE2 CE3 CZ2 CZ3 CH2 CD CE CZ CZ1 CH", "TYR": "CB CG CD1 CD2 CE1 CE2 CZ OH CD CE", "VAL": "CB CG1 CG2",
}
TRIGONAL_CARBONS = {
    "ARG": "CZ", "ASN": "CG", "ASP": "CG", "GLN": "CD", "GLU": "CD", "HIS": "CG CD2 CE1", "PHE": "CG CD1 CD2 CE1 CE2 CZ",
    "TRP": "CG CD1 CD2 CE2 CE3 CZ2 CZ3 CH2 CD CE CZ CZ1 CH", "TYR": "CG CD1 CD2 CE1 CE2 CZ CD CE",
}
CHARGED_NITROGENS = {"ARG": "NE NH1 NH2", "LYS": "NZ"}
BACKBONE = "N CA C O OXT"


def tidy(name: Column) -> Column:
    return F.upper(F.trim(F.coalesce(name, F.lit(""))))


def residue_class(res_name: Column) -> Column:
    """protein, dna, rna, water, ions, or ligand for every other name, a null one included."""
    name, out = tidy(res_name), F
    for cls, names in (("protein", PROTEIN), ("dna", DNA), ("rna", RNA), ("water", WATER), ("ions", IONS)):
        out = out.when(name.isin(*names), cls)
    return out.otherwise("ligand")


def category(name: str) -> str | None:
    """The class that a user's word for it means; None if it is no category."""
    return next((cls for cls, words in CATEGORIES.items() if name.strip().lower() in words.split()), None)


def is_water(res_name: Column) -> Column:
    return tidy(res_name).isin(*WATER)


def is_solvent(res_name: Column) -> Column:
    return tidy(res_name).isin(*WATER, *SOLVENT_IONS)


def atom_class(res_name: Column, element: Column) -> Column:
    """nonpolar for carbon and hydrogen, excluded for water, ions and massless sites, other for the rest."""
    gone = residue_class(res_name).isin("water", "ions") | tidy(element).isin("M", "MW")
    return F.when(gone, "excluded").when(tidy(element).isin("C", "H"), "nonpolar").otherwise("other")


def pair_class(a: Column, b: Column) -> Column:
    """Of two atom classes: excluded if either is, nonpolar if both are, mixed if one is, else other."""
    either = lambda x: (a == x) | (b == x)
    return F.when(either("excluded"), "excluded").when((a == "nonpolar") & (b == "nonpolar"), "nonpolar").when(either("nonpolar"), "mixed").otherwise("other")


def element_of(name: Column, res_name: Column) -> Column:
    """From an atom's name: in water the O or H it has, SE alone or before a digit, else its first letter if that is one of
    C, O, H, N, P, S, else H."""
    n = tidy(name)
    water = tidy(res_name).isin("SOL", "HOH")
    first = F.substring(n, 1, 1)
    return (
        F.when(water & n.contains("O"), "O").when(water & n.contains("H"), "H").when(n.rlike("^SE($|[0-9])"), "SE")
        .when(first.isin(*"COHNPS"), first).otherwise("H")
    )


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def radius_of(res_name: Column, name: Column, element: Column, elements: dict[str, float], specials: dict[tuple[str, str], float]) -> Column:
    """The radius of a residue's atom by the longest beginning of its name that specials has, else that of the element, else
    null."""
    n, keys = tidy(name), {f"{r}:{a}": x for (r, a), x in specials.items()}
    found = [lookup(keys, F.concat_ws(":", tidy(res_name), F.substring(n, 1, k))) for k in sorted({len(a) for _, a in specials}, reverse=True)]
    return F.coalesce(*found, lookup(elements, tidy(element))) if keys else lookup(elements, tidy(element))


def united_radii() -> dict[tuple[str, str], float]:
    """(residue, atom) to the radius of its group, by the rules of the classes."""
    out = {}
    for res, side in SIDE_CHAINS.items():
        for atom in f"{BACKBONE} {side}".split():
            has = lambda table: atom in table.get(res, "").split()  # noqa: E731, B023
            carbon = TRIGONAL if atom == "C" or has(TRIGONAL_CARBONS) else ALIPHATIC
            out[res, atom] = {"C": carbon, "N": CHARGED if has(CHARGED_NITROGENS) else NEUTRAL, "O": OXYGEN, "S": SULPHUR}[atom[0]]
    return out


def united_radius(res_name: Column, name: Column, element: Column) -> Column:
    """The base radius of an atom's group; where residue and name say nothing, oxygen's and sulphur's by element, else 2."""
    keys = {f"{r}:{a}": x for (r, a), x in united_radii().items()}
    by_element = F.when(tidy(element) == "O", OXYGEN).when(tidy(element) == "S", SULPHUR).otherwise(OTHER)
    return F.coalesce(lookup(keys, F.concat_ws(":", tidy(res_name), tidy(name))), by_element)


def expanded_radius(base: Column, probe: float = PROBE) -> Column:
    return base + F.lit(probe)


def power_weight(base: Column, probe: float = PROBE) -> Column:
    return expanded_radius(base, probe) * expanded_radius(base, probe)
