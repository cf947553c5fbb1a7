"""What documents look like, as data: element paths, the declared dictionary, the mapping corpus, accepted values."""

from __future__ import annotations

from dataclasses import dataclass, field

ROOT = "StandardBillingDocument"
VARIANTS = ("DetailedInvoice", "SummaryInvoice")


@dataclass(frozen=True)
class Field:
    """A flat column and the element paths that can hold it, first found wins; type is string, double or long."""

    name: str
    paths: tuple[str, ...]
    type: str = "string"


def fields(text: str) -> tuple[Field, ...]:
    """One column a line: name, path or path|path..., and a type if it isn't string."""
    out = []
    for line in text.strip().splitlines():
        name, paths, *kind = line.split()
        out.append(Field(name, tuple(paths.split("|")), kind[0] if kind else "string"))
    return tuple(out)


HEADER = fields("""
    document_number DocumentNumber
    document_date DocumentDate
    document_type DocumentType
    submission_method SubmissionMethod
    currency_code CurrencyCode
    total Total double
    vendor_total VendorTotal double
    line_count LineCount long
    notes Notes
    period_date PeriodDate
    discount_total DiscountTotal double
    action_type Action/ActionType
    action_status Action/Status
    action_datetime Action/TransactionDateTime
""")

PARTY = fields("""
    entity_code Entity/EntityCode
    entity_code_type Entity/EntityCode@EntityCodeType
    entity_name Entity/EntityName
    location_code Location/LocationCode
    location_name Location/LocationName
    city Location/Address/City
    state Location/Address/StateProvinceCode
    country_code Location/Address/CountryCode
""")
PARTY_ROLES = ("Vendor", "Client")

LINE = fields("""
    service_code ServiceItem/ServiceCode
    product_description ServiceItem/ProductDescription
    product_category ServiceItem/ProductCategory
    quantity Quantity double
    units Units
    unit_price UnitPrice double
    line_subtotal LineSubTotal double
    line_pretax_total LinePretaxTotal double
    line_total Total double
    period_start_date PeriodStartDate
    period_date PeriodDate
    notes Notes
    charge_class ChargeClass
    purchase_category PurchaseCategory
    category_code Category/CategoryCode
    category_scheme Category@CategorizationScheme
    discount_total Discount/Total double
    discount_rate Discount/AllocationRate double
    cross_ref_doc_number CrossReference/DocumentNumber
    cross_ref_doc_type CrossReference/DocumentType
    cross_ref_date CrossReference/Date
    tax_type TaxEntry/TaxType
    tax_total TaxEntry/Total double
    tax_exempt_code TaxEntry/ExemptCode
    early_pay_due_date EarlyPayment/DueDate
    early_pay_days_due EarlyPayment/DaysDue long
    early_pay_eligible EarlyPayment/EligibleFlag
""")

#: Where documents that put the same things directly under the line have them; opt in with FLAT.
FLAT_PATHS = {
    "service_code": "ServiceCode", "product_description": "ProductDescription", "product_category": "ProductCategory", "category_code": "CategoryCode",
    "tax_type": "TaxType", "tax_exempt_code": "ExemptCode", "early_pay_due_date": "DueDate", "early_pay_days_due": "DaysDue", "early_pay_eligible": "EligibleFlag",
    "entity_code_type": "Entity@EntityCodeType",
}

ALLOCATION = fields("""
    alloc_rate AllocationRate double
    alloc_total Total double
    alloc_cost_center CostCenter
    alloc_project_code ProjectCode
    alloc_work_order WorkOrder
    alloc_order_ref OrderReference
    alloc_site_ref_name SiteReference/SiteRefName
    alloc_account_major AccountInfo/AccountMajor/AccountCode
    alloc_account_minor AccountInfo/AccountMinor/AccountCode
    alloc_account_type AccountInfo/AccountMajor/AccountType
""")


@dataclass(frozen=True)
class Profile:
    """The columns to extract; `also` adds an alternative path to columns by name."""

    header: tuple[Field, ...] = HEADER
    party: tuple[Field, ...] = PARTY
    line: tuple[Field, ...] = LINE
    allocation: tuple[Field, ...] = ALLOCATION
    namespace: str | None = None

    def also(self, more: dict[str, str]) -> Profile:
        def add(known: tuple[Field, ...]) -> tuple[Field, ...]:
            return tuple(Field(f.name, (*f.paths, more[f.name]), f.type) if f.name in more else f for f in known)

        return Profile(add(self.header), add(self.party), add(self.line), add(self.allocation), self.namespace)

    def only(self, header: str = "", party: str = "", line: str = "", allocation: str = "") -> Profile:
        """The columns named, "*" for all of a table: what is not asked for need not be parsed."""
        def keep(known: tuple[Field, ...], names: str) -> tuple[Field, ...]:
            return known if names == "*" else tuple(f for f in known if f.name in names.split())

        return Profile(keep(self.header, header), keep(self.party, party), keep(self.line, line), keep(self.allocation, allocation), self.namespace)


DEFAULT = Profile()
FLAT = DEFAULT.also(FLAT_PATHS)


@dataclass(frozen=True)
class Declared:
    """A field of the declared dictionary: its type, its position and the variants that have it."""

    name: str
    type: str
    position: str
    variants: tuple[str, ...]


def _declared(position: str, both: str, detailed: str = "") -> list[Declared]:
    """Names are name:type, string if no type is given."""
    out = []
    for text, variants in ((both, ("both",)), (detailed, ("DetailedInvoice",))):
        for word in text.split():
            name, _, kind = word.partition(":")
            out.append(Declared(name, kind or "string", position, variants))
    return out


BASELINE: tuple[Declared, ...] = tuple(
    _declared(
        "header",
        "DocumentNumber DocumentDate:date DocumentType SubmissionMethod CurrencyCode Total:decimal VendorTotal:decimal LineCount:integer "
        "Notes PeriodDate:date DiscountTotal:decimal ActionType Status TransactionDateTime:datetime TransactionIdentifier EntityCode "
        "EntityName LocationCode LocationName AddressLine City StateProvinceCode CountryCode PostalZipCode PhoneNumber EmailAddress "
        "DepartmentName FirstName LastName StateProvince Country LocationPath ContentType",
    )
    + _declared(
        "line",
        "LineNumber:integer ChargeClass PurchaseCategory Quantity:decimal UnitPrice:decimal CategoryCode",
        "Units LineSubTotal:decimal LinePretaxTotal:decimal PeriodStartDate:date ServiceCode ProductDescription ProductCategory TaxType "
        "ExemptCode DueDate:date DaysDue:integer EligibleFlag",
    )
    + _declared("allocation", "AllocationRate:decimal CostCenter SiteRefName AccountCode", "ProjectCode WorkOrder OrderReference")
)

#: Elements that only hold others; they are walked through and never reported.
STRUCTURAL = frozenset(
    "AccountCode AccountInfo AccountMajor AccountMinor AccountType Action ActionDestination ActionSource Address Allocation Attachment "
    "Attachments Category Contact ContactNameOrLocation ContentType CrossReference Department Description DetailedInvoice Discount "
    "DocumentHeader DocumentLines EarlyPayment Entity GeographicLocation LineEntry Location LocationPath Metadata Notice NoticeType Party "
    "ProductServiceCategory ProductServiceDescription RefData RefInfo ServiceItem SiteReference StandardBillingDocument SummaryInvoice "
    "TaxEntry Value".split()
)


@dataclass(frozen=True)
class Target:
    """A known flat column that a new field may be mapped to."""

    name: str
    type: str
    position: str
    description: str = field(default="", compare=False)


def _targets(text: str) -> tuple[Target, ...]:
    """One target a line, name:type:position:description, string if no type is given."""
    parts = (x.strip().split(":", 3) for x in text.strip().splitlines())
    return tuple(Target(name, kind or "string", position, description) for name, kind, position, description in parts)


CORPUS = _targets("""
    invoice_total:decimal:header:amount that the whole document asks for
    vendor_total:decimal:header:amount of the document as the vendor states it
    document_number::header:number by which its issuer knows the document
    document_date:date:header:day on which the document was issued
    document_type::header:kind of document, such as an invoice or a credit
    currency_code::header:three-letter code of the currency of all amounts
    vendor_entity_name::header:name of the company that sends the document
    client_entity_name::header:name of the company that receives and pays it
    vendor_entity_code::header:short code of the sending company
    client_entity_code::header:short code of the paying company
    action_status::header:state of the document in its approval, such as approved or disputed
    action_datetime:datetime:header:moment at which that state was reached
    line_total:decimal:line:amount of the line with everything on it
    line_subtotal:decimal:line:amount of the line before discounts and taxes
    line_pretax_total:decimal:line:amount of the line after discounts and before taxes
    line_number:integer:line:place of the line in its document
    quantity:decimal:line:how many units the line is for
    unit_price:decimal:line:price of one unit
    units::line:what a unit is, such as hours or barrels
    service_code::line:code of the service or product delivered
    product_description::line:what was delivered, in words
    product_category::line:group of products or services that it belongs to
    charge_class::line:whether the charge is itemised or short-paid
    period_date:date:line:end of the period that is charged for
    period_start_date:date:line:start of the period that is charged for
    tax_type::line:kind of tax on the line
    tax_total:decimal:line:amount of tax on the line
    tax_exempt_code::line:why no tax is due
    due_date:date:line:day up to which early payment counts
    days_due:integer:line:days until payment is due
    cross_ref_doc_number::line:number of another document that the line refers to
    cross_ref_doc_type::line:kind of that other document, such as a field ticket
    discount_total:decimal:line:amount taken off the line
    discount_rate:decimal:line:share taken off the line
    cost_center::allocation:unit of the client that bears the cost
    project_code::allocation:project or budget that the cost goes to
    work_order::allocation:order of work under which it was done
    order_reference::allocation:purchase order that it was bought under
    alloc_rate:decimal:allocation:share of the line that this allocation takes
    alloc_total:decimal:allocation:amount of the line that this allocation takes
""")

#: Parents that place a field, looked at in this order.
POSITIONS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("header", tuple("DocumentHeader DocumentNumber DocumentDate DocumentType CurrencyCode".split())),
    ("line", tuple("LineEntry LineNumber DocumentLines Quantity".split())),
    ("allocation", tuple("Allocation AllocationRate CostCenter".split())),
)

AUTO, REVIEW = 0.90, 0.70

STATUSES = ("Approved", "Cancelled", "Disputed", "On Hold", "Pending", "Re-Submitted", "Rejected", "Submitted")
CHARGE_CLASSES = ("Itemized", "Non-Itemized", "ShortPay")
CURRENCIES = ("CAD", "USD", "UYI")
YEARS = tuple(range(2010, 2027))
