"""Declared schemas of landed data; nothing is inferred."""

BARS = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume bigint, source string, updated_at timestamp"
SPOT = "ticker string, captured_at timestamp, price double, previous_close double, currency string, source string"
INSIDER = "ticker string, date date, owner string, role string, code string, shares bigint, price double, value bigint, plan boolean, accession string"
QUOTE = "ticker string, price double, change double, change_pct double, open double, high double, low double, prev_close double, quote_time timestamp"
SNAPSHOT = f"as_of timestamp, source string, count int, requested array<string>, errors array<string>, quotes array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in QUOTE.split(','))}>>"
ISSUER_IDS = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
FILING_INDEX = (
    "ticker string, cik string, filings struct<recent: struct<form: array<string>, filingDate: array<date>, accessionNumber: array<string>, "
    "primaryDocument: array<string>>, files: array<struct<name: string, filingTo: date>>>"
)
_VALUE = "struct<value: string>"
FORM4 = (
    "reportingOwner array<struct<reportingOwnerId: struct<rptOwnerName: string>, reportingOwnerRelationship: struct<isDirector: string, "
    "isOfficer: string, isTenPercentOwner: string, officerTitle: string>>>, aff10b5One string, footnotes struct<footnote: array<string>>, "
    f"nonDerivativeTable struct<nonDerivativeTransaction: array<struct<transactionDate: {_VALUE}, transactionCoding: struct<transactionCode: string>, "
    f"transactionAmounts: struct<transactionShares: {_VALUE}, transactionPricePerShare: {_VALUE}>>>>"
)
FORM144 = (
    "formData struct<issuerInfo: struct<issuerCik: string, nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold: string, "
    "relationshipsToIssuer: struct<relationshipToIssuer: array<string>>>, securitiesInformation: array<struct<noOfUnitsSold: string, "
    "aggregateMarketValue: string, approxSaleDate: string>>>"
)
