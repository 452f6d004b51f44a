"""Lookup values: placeholder labels, entity types and confidence thresholds."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type -> placeholder label.  Any other type gets REDACTED_<TYPE>.
MASK_LABELS = {
    "email": "REDACTED_EMAIL",
    "phone": "REDACTED_PHONE",
    "ssn": "REDACTED_SSN",
    "creditCard": "REDACTED_CREDIT_CARD",
    "zipCode": "REDACTED_ZIP",
    "ipv4": "REDACTED_IP",
    "dateOfBirth": "REDACTED_DOB",
    "passport": "REDACTED_PASSPORT",
    "driversLicense": "REDACTED_LICENSE",
    "bankAccount": "REDACTED_ACCOUNT",
    "medicalRecord": "REDACTED_MEDICAL_ID",
    "vin": "REDACTED_VIN",
    "policyNumber": "REDACTED_POLICY",
    "routingNumber": "REDACTED_ROUTING",
    "person": "REDACTED_NAME",
    "organization": "REDACTED_ORGANIZATION",
    "location": "REDACTED_LOCATION",
    "titleName": "REDACTED_NAME",
}

# Tag of the token classifier -> type.  Any other tag loses its B- or I-
# prefix and is lower-cased.
ENTITY_TYPES = {
    "I-ACCOUNTNUM": "account",
    "I-BUILDINGNUM": "building",
    "I-CITY": "location",
    "I-CREDITCARDNUMBER": "creditCard",
    "I-DATEOFBIRTH": "dateOfBirth",
    "I-DRIVERLICENSENUM": "license",
    "I-EMAIL": "email",
    "I-GIVENNAME": "person",
    "I-IDCARDNUM": "idCard",
    "I-PASSWORD": "password",
    "I-SOCIALNUM": "ssn",
    "I-STREET": "address",
    "I-SURNAME": "person",
    "I-TAXNUM": "taxId",
    "I-TELEPHONENUM": "phone",
    "I-USERNAME": "username",
    "I-ZIPCODE": "zipcode",
    "O": "none",
    "B-PER": "person",
    "I-PER": "person",
    "B-LOC": "location",
    "I-LOC": "location",
    "B-ORG": "organization",
    "I-ORG": "organization",
    "B-MISC": "misc",
    "I-MISC": "misc",
}

# Lower-cased type -> (first gate, second gate).
CONFIDENCE = {
    "socialnumber": (0.80, 0.70),
    "driverlicense": (0.75, 0.65),
    "passport": (0.75, 0.65),
    "idcard": (0.75, 0.65),
    "pass": (0.80, 0.70),
    "givenname1": (0.60, 0.50),
    "givenname2": (0.60, 0.50),
    "lastname1": (0.60, 0.50),
    "lastname2": (0.60, 0.50),
    "lastname3": (0.60, 0.50),
    "email": (0.80, 0.60),
    "tel": (0.90, 0.55),
    "ip": (0.75, 0.60),
    "username": (0.65, 0.55),
    "city": (0.55, 0.40),
    "country": (0.55, 0.40),
    "state": (0.55, 0.40),
    "street": (0.60, 0.45),
    "building": (0.60, 0.45),
    "postcode": (0.60, 0.45),
    "secaddress": (0.60, 0.45),
    "geocoord": (0.65, 0.50),
    "bod": (0.70, 0.45),
    "date": (0.60, 0.40),
    "time": (0.60, 0.40),
    "title": (0.50, 0.40),
    "sex": (0.65, 0.50),
}
DEFAULT_CONFIDENCE = (0.60, 0.45)


def _lookup(values: dict, key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.try_element_at(table, key)


def mask_label(kind: Column) -> Column:
    """The placeholder that replaces a value of this type, e.g. ``[REDACTED_EMAIL]``."""
    label = F.coalesce(
        _lookup(MASK_LABELS, kind), F.concat(F.lit("REDACTED_"), F.upper(kind))
    )
    return F.concat(F.lit("["), label, F.lit("]"))


def mask_for(name: str) -> str:
    """``mask_label`` of a type known when the plan is built."""
    return f"[{MASK_LABELS.get(name, 'REDACTED_' + name.upper())}]"


def map_entity(tag: Column) -> Column:
    plain = F.lower(F.regexp_replace(tag, "^[BI]-", ""))
    return F.coalesce(_lookup(ENTITY_TYPES, tag), plain)


def plain_type(kind: Column) -> Column:
    """Type as the thresholds and validity rules spell it: lower case, no B- or I- prefix."""
    known = {name: name.lower() for name in ENTITY_TYPES.values()}
    # lower is slow for what is nearly always one of a few known names
    return F.coalesce(_lookup(known, kind), F.regexp_replace(F.lower(kind), "^[bi]-", ""))


def min_confidence(kind: Column, gate: int) -> Column:
    """Threshold of a type at the first (0) or second (1) gate."""
    table = {name: pair[gate] for name, pair in CONFIDENCE.items()}
    default = DEFAULT_CONFIDENCE[gate]
    known = {name: table.get(name.lower(), default) for name in ENTITY_TYPES.values()}
    return F.coalesce(
        _lookup(known, kind), _lookup(table, plain_type(kind)), F.lit(default)
    )
