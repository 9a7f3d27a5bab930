"""Fixed values.

Every list, lookup table, constant and message format below must hold exactly
these values for results to come out right, so they are stated as plain text.
"""

SPRINT_DAYS = 14

SEVERITIES = ["critical", "high", "medium", "low", "info"]

# Alerts use one severity more than violations do.
ALERT_SEVERITIES = SEVERITIES + ["warning"]

CATEGORIES = [
    "security",
    "coding_standards",
    "data_privacy",
    "dependency_management",
    "architecture",
    "documentation",
    "testing",
    "performance",
]

# USD per 1000 tokens: model -> (input, output)
MODEL_PRICES = {
    "claude-sonnet-4": ("0.003", "0.015"),
    "claude-opus-4": ("0.015", "0.075"),
    "gpt-4o": ("0.005", "0.015"),
    "claude-haiku-4": ("0.001", "0.005"),
}

SEVERITY_COLORS = {
    "critical": "#E24B4A",
    "high": "#D85A30",
    "medium": "#BA7517",
    "low": "#378ADD",
    "info": "#888780",
}
DEFAULT_COLOR = "#888780"

# Lowest score of a band, best first: (score, band, colour)
COMPLIANCE_BANDS = [
    (90, "excellent", "#639922"),
    (75, "good", "#1D9E75"),
    (60, "needs_improvement", "#BA7517"),
    (0, "critical", "#E24B4A"),
]

KPI_COLORS = {"red": "#E24B4A", "amber": "#BA7517", "green": "#639922"}

TEAM_COLORS = {
    "Platform Engineering": "#534AB7",
    "Data Services": "#1D9E75",
    "Customer Portal": "#D85A30",
    "ML Ops": "#378ADD",
}

CATEGORY_LABELS = {
    "security": "Security",
    "coding_standards": "Coding Standards",
    "data_privacy": "Data Privacy",
    "dependency_management": "Dependencies",
    "architecture": "Architecture",
    "testing": "Testing",
    "documentation": "Documentation",
    "performance": "Performance",
}

SHORT_CATEGORY_LABELS = {
    "security": "Security",
    "coding_standards": "Coding Std",
    "data_privacy": "Data Privacy",
    "dependency_management": "Dependencies",
    "architecture": "Architecture",
    "testing": "Testing",
    "documentation": "Docs",
    "performance": "Performance",
}

ALERT_CLASSES = {
    "critical": "alert-critical",
    "high": "alert-high",
    "warning": "alert-warning",
    "medium": "alert-warning",
    "info": "alert-info",
    "low": "alert-info",
}
DEFAULT_ALERT_CLASS = "alert-info"

ALERT_ICONS = {
    "critical": "🔴",
    "high": "🟠",
    "warning": "🟡",
    "medium": "🟡",
    "info": "🔵",
    "low": "🔵",
}
DEFAULT_ALERT_ICON = "ℹ️"

ALL_TEAMS = "All Teams"

# alert type -> (severity, title, message)
ALERT_TEMPLATES = {
    "token_budget": (
        "warning",
        "Token budget threshold reached",
        "{team} has consumed {pct}% of sprint token budget",
    ),
    "compliance_drop": (
        "high",
        "Compliance score dropped",
        "{team} compliance dropped below {threshold}% in {category}",
    ),
    "security_incident": (
        "critical",
        "New security incident",
        "PII exposure detected in {team} codebase",
    ),
    "quality_gate": (
        "medium",
        "Quality gate failure",
        "{team} failed SonarQube quality gate in Sprint {sprint}",
    ),
    "adoption_milestone": (
        "info",
        "Adoption milestone",
        "{team} reached {pct}% AI adoption rate",
    ),
}
ALERT_SOURCE = "governance_engine"
QUALITY_GATE = "CS-001"

VIOLATION_TEXT = "Violation of {policy} detected in AI-generated code"

ROI_USD_PER_POINT = 250
AI_LINE_SHARE = 0.6

TOKENS_PER_DEVELOPER = 150000
TEAM_BUDGET_MULTIPLIER = "1.2"
BUDGET_ALERT_PCT = 80
BUDGET_ESCALATION_PCT = 100

# (id, name, description, category, severity, applies_to, threshold, tool)
POLICIES = [
    ("SEC-001", "No Hardcoded Secrets",
     "API keys, passwords, and tokens must not appear in source code",
     "security", "critical", ["developer", "tech_lead", "security_team"], 0, "gitleaks"),
    ("SEC-002", "No SQL Injection Patterns",
     "All database queries must use parameterized statements",
     "security", "critical", ["developer", "tech_lead"], 0, "bandit"),
    ("SEC-003", "Input Validation Required",
     "All external inputs must be validated and sanitized",
     "security", "high", ["developer"], 2, "semgrep"),
    ("SEC-004", "No Shell Injection",
     "Subprocess calls must not use shell=True with user input",
     "security", "critical", ["developer", "tech_lead"], 0, "bandit"),
    ("CS-001", "SonarQube Quality Gate",
     "Code must pass SonarQube quality gate (A or B rating)",
     "coding_standards", "high", ["developer", "tech_lead"], 80, "sonarqube"),
    ("CS-002", "Code Complexity Limit",
     "Cyclomatic complexity must not exceed 15 per function",
     "coding_standards", "medium", ["developer"], 15, "radon"),
    ("CS-003", "Docstring Coverage",
     "Public functions and classes must have docstrings",
     "coding_standards", "low", ["developer"], 70, "interrogate"),
    ("CS-004", "Type Hint Coverage",
     "Functions must have type annotations",
     "coding_standards", "medium", ["developer"], 60, "mypy"),
    ("DP-001", "No PII in Logs",
     "Personally identifiable information must not be written to log files",
     "data_privacy", "critical", ["developer", "tech_lead", "security_team"], 0,
     "custom_pii_scanner"),
    ("DP-002", "Data Classification Headers",
     "Files handling sensitive data must include classification headers",
     "data_privacy", "high", ["developer", "tech_lead"], 90, "custom_classifier"),
    ("DP-003", "Encryption at Rest",
     "Sensitive data must be encrypted when stored",
     "data_privacy", "critical", ["developer", "tech_lead", "security_team"], 0,
     "custom_crypto_check"),
    ("DM-001", "No Known Vulnerabilities",
     "Dependencies must not have known CVEs with severity >= High",
     "dependency_management", "high", ["developer", "tech_lead"], 0, "safety"),
    ("DM-002", "Approved Packages Only",
     "Only pre-approved packages may be added to requirements",
     "dependency_management", "medium", ["developer"], 95, "custom_allowlist"),
    ("AR-001", "API Design Standards",
     "REST APIs must follow organizational naming and versioning conventions",
     "architecture", "medium", ["developer", "tech_lead"], 85, "spectral"),
    ("AR-002", "No Direct DB Access from UI",
     "Frontend code must not contain direct database connection strings",
     "architecture", "high", ["developer", "tech_lead"], 0, "custom_arch_check"),
    ("TS-001", "Minimum Test Coverage",
     "Code coverage must be at least 70%",
     "testing", "high", ["developer", "tech_lead"], 70, "coverage"),
    ("TS-002", "AI-Generated Code Tests",
     "AI-generated code must have corresponding unit tests",
     "testing", "high", ["developer"], 80, "custom_ai_test_check"),
    ("DC-001", "README Completeness",
     "Repositories must have up-to-date README with setup instructions",
     "documentation", "low", ["tech_lead"], 90, "custom_readme_check"),
    ("PF-001", "No N+1 Queries",
     "Database access patterns must not exhibit N+1 query anti-patterns",
     "performance", "medium", ["developer", "tech_lead"], 0, "custom_query_analyzer"),
]

# role -> policies listed for the role
ROLE_POLICIES = {
    "developer": [
        "SEC-001", "SEC-002", "SEC-003", "SEC-004", "CS-001", "CS-002", "CS-003", "CS-004",
        "DP-001", "DP-002", "DM-001", "DM-002", "AR-001", "AR-002", "TS-001", "TS-002",
    ],
    "tech_lead": [
        "SEC-001", "SEC-002", "SEC-004", "CS-001", "CS-002", "DP-001", "DP-002", "DP-003",
        "DM-001", "AR-001", "AR-002", "TS-001", "DC-001", "PF-001",
    ],
    "security_team": [
        "SEC-001", "SEC-002", "SEC-003", "SEC-004", "DP-001", "DP-003", "DM-001",
    ],
    "management": [],
}
ROLES = ["developer", "tech_lead", "security_team", "management"]

# Policies judged on a quality measure: policy -> (column, direction).
# "min": the mean must reach the threshold; "max": it must not exceed it.
MEASURED_POLICIES = {
    "CS-001": ("sonarqube_score", "min"),
    "CS-002": ("complexity_avg", "max"),
    "CS-003": ("docstring_coverage_pct", "min"),
    "CS-004": ("type_hint_coverage_pct", "min"),
    "TS-001": ("test_coverage_pct", "min"),
}
# Policies that no stored column can judge.
UNMEASURED_POLICIES = ["DP-002", "DM-002", "AR-001", "TS-002", "DC-001"]
# All other policies are judged on their number of violations.

# Alerting limits of our own choice, where only the alert type is given.
COMPLIANCE_ALERT_BELOW = 60
ADOPTION_MILESTONE_PCT = 75

# Text patterns of our own choice. Numbers stand by themselves: digits within a
# longer number, word or hash are none.
#
# An e-mail address may only start where no character of its local part stands
# before it, or right where the last hit ended. Without that, a long unbroken
# run of letters would be searched again from each of its characters.
TEXT_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
    r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "credit_card": r"\b[0-9]{16}\b",
    "secret": r'token = "[0-9a-f]{40}"',
}

# A text without this literal holds no hit of the kind. Looking for a literal is
# many times cheaper than running a pattern over the text.
TEXT_MARKS = {
    "email": "@",
    "phone": "+1 (",
    "secret": 'token = "',
}
