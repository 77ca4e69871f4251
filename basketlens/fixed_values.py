"""Labels, edges and texts that results must carry as they are."""

# --- fixed values -----------------------------------------------------------

# Age bands: (exclusive upper age, label); the last band is open.
AGE_BANDS = ((30, "18-29"), (40, "30-39"), (50, "40-49"), (60, "50-59"), (None, "60+"))

# Price bands: (exclusive upper price, label); the last band is open.
PRICE_BANDS = ((20, "0-20"), (50, "20-50"), (100, "50-100"), (200, "100-200"), (None, "200+"))

# Price tiers of a category by its mean price: (exclusive upper price, tier).
PRICE_TIERS = ((30, "Economy"), (80, "Mid-range"), (150, "Premium"), (None, "Luxury"))

AGE_BAND_STRATEGIES = {
    "18-29": "Social media marketing, mobile payment promotions, youth-exclusive discounts",
    "30-39": "Family packages, credit card reward points, convenient payment experience",
    "40-49": "Quality assurance, membership privileges, diverse payment options",
    "50-59": "Traditional channel promotion, large discounts, credit payment promotion",
    "60+": "Simple and easy-to-use payment methods, offline events, attentive service",
}

PRICE_BAND_CHARACTERS = {
    "0-20": "Budget products, high volume potential",
    "20-50": "Value segment, competitive pricing",
    "50-100": "Mid-market, quality focus",
    "100-200": "Premium products, feature-rich",
    "200+": "High-end products, exclusive market",
}

PRICE_TIER_STRATEGIES = {
    "Economy": "Economy segment - focus on volume sales, bundle offers",
    "Mid-range": "Mid-range segment - balance quality and affordability",
    "Premium": "Premium segment - emphasize quality and features",
    "Luxury": "Luxury segment - focus on exclusivity and premium experience",
}

HIGH_VALUE = "High Value"
REGULAR = "Regular"
AT_RISK = "At Risk"
LOW_ACTIVITY = "New/Low Activity"
SEGMENTS = (HIGH_VALUE, REGULAR, AT_RISK, LOW_ACTIVITY)

SEGMENT_PLAYBOOK = {
    "High Value": (
        "High spending, frequent purchases, recent activity",
        (
            "VIP treatment with exclusive offers",
            "Personalized product recommendations",
            "Loyalty program with premium benefits",
            "Early access to new products",
            "Dedicated customer service",
        ),
    ),
    "Regular": (
        "Moderate spending and frequency, stable activity",
        (
            "Cross-selling and up-selling opportunities",
            "Moderate loyalty rewards",
            "Seasonal promotions",
            "Product bundle offers",
            "Email marketing with personalized content",
        ),
    ),
    "At Risk": (
        "Long time since last purchase, potential churn",
        (
            "Win-back campaigns with special discounts",
            "Re-engagement emails",
            "Survey to understand reasons for inactivity",
            "Limited-time exclusive offers",
            "Personalized we miss you messages",
        ),
    ),
    "New/Low Activity": (
        "Low spending, infrequent purchases, or new customers",
        (
            "Welcome series for new customers",
            "Educational content about products",
            "Small incentive for second purchase",
            "Simple loyalty program introduction",
            "Social proof and testimonials",
        ),
    ),
}

HIGH = "High"
LOW = "Low"
VALUE_CLASSES = (HIGH, LOW)

# Growth forecast: assumed monthly growth of the high-value share.
MONTHLY_GROWTH = 0.02
# Customers silent for longer than this many days are at risk.
CHURN_DAYS = 180
# Headline growth (percent a month) is never reported below this floor.
GROWTH_FLOOR = 5

INVOICE_DATE_FORMAT = "d/M/yyyy"

# --- end of fixed values ----------------------------------------------------
