import pytest

from balancier.functions.predicates import operator_name
from balancier.plans import catalog as K
from balancier.plans.specs import fields_of, read_spec

SUM = {"type": "AGGREGATION", "function": "SUM", "field": "soldeconvertie"}


def wrap(**parts):
    return {"expression": SUM, **parts}


def test_57_canonical_fields():
    assert len(K.FIELDS) == 57
    assert len({f.flat for f in K.FIELDS}) == 57


@pytest.mark.parametrize(
    "spelling, canonical",
    [
        ("SOLDECONVERTIE", "soldeconvertie"), ("f.id_agence", "idAgence"), ("idagence", "idAgence"),
        ("cl.idresidence", "dimClient.idResidence"), ("id_grpaffaire", "dimClient.idGrpaffaire"),
        ("iddouteux", "dimClient.idDouteux"), ("dc.anciennete_impaye", "dimContrat.ancienneteimpaye"),
        ("contratactif", "dimContrat.actif"), ("actif", "actif"), ("devise", "subDimDevise.devise"),
        ("sub_dim_devise.devise", "subDimDevise.devise"), ("sub_dim_date.date_value", "subDimDate.dateValue"),
        ("dateecheance", "dimContrat.subDimDateEcheance.dateValue"), ("sectionactivite", "subDimSectionactivite.libelle"),
        ("sub_dim_objetfinance.libelle", "dimContrat.subDimObjetfinance.libelle"), ("chapitre", "subDimChapitre.chapitre"),
        ("grpaffaire", "subDimGrpaffaire.nomgrpaffaires"), (" numagencecontrat ", "dimContrat.subDimAgence.numagence"),
    ],
)
def test_aliases(spelling, canonical):
    assert K.resolve(spelling).name == canonical


def test_unknown_field():
    with pytest.raises(K.SpecError, match="Unknown field: nope"):
        K.resolve("nope")
    assert not K.exists("libelle")  # three tables have one


def test_only_needed_roles_parents_first():
    assert K.needed_roles(["soldeconvertie"]) == []
    assert K.needed_roles(["contratActif"]) == ["dc"]
    assert K.needed_roles(["douteux"]) == ["cl", "dout"]
    assert K.needed_roles(["douteux", "numagencecontrat", "douteux"]) == ["cl", "dc", "dout", "agc"]


@pytest.mark.parametrize("raw, name", [("starts with", "STARTS_WITH"), ("BeginsWith", "STARTS_WITH"), ("<>", "NE"), ("not  in", "NOT_IN")])
def test_operator_spellings(raw, name):
    assert operator_name(raw) == name


@pytest.mark.parametrize(
    "spec, message",
    [
        (wrap(orderBy=["value"], limit=5, top=5), "not both"),
        (wrap(limit=5), "in some order"),
        (wrap(orderBy=["nope"], limit=5), "Unknown field: nope"),
        (wrap(groupBy=["idAgence"], orderBy=["idDevise"]), "no idDevise to be ordered by"),
        (wrap(orderBy=["value"], limit=0), "whole number above 0"),
        (wrap(where={"field": "nope", "operator": "=", "value": 1}), "Unknown field: nope"),
        ({"type": "MODULO", "left": SUM, "right": SUM}, "no such expression node"),
    ],
)
def test_rejections(spec, message):
    with pytest.raises(K.SpecError, match=message):
        read_spec(spec)


def test_any_depth():
    node = SUM
    for _ in range(40):
        node = {"type": "ADD", "left": node, "right": {"type": "VALUE", "value": 1}}
    assert fields_of(read_spec(node)) == ["soldeconvertie"]


def test_fields_ignore_order_unless_asked():
    spec = read_spec(wrap(groupBy=["idAgence"], orderBy=["idAgence", "value"], where=[{"field": "pays", "operator": "IS NULL"}]))
    assert fields_of(spec) == ["soldeconvertie", "subDimResidence.pays", "idAgence"]
    spec = read_spec(wrap(orderBy=["douteux"]))
    assert fields_of(spec) == ["soldeconvertie"]
    assert fields_of(spec, with_order=True) == ["soldeconvertie", "subDimDouteux.douteux"]
