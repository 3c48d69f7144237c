"""Texts the views show."""

# Fallbacks for missing data.
UNKNOWN = "Unknown"
UNKNOWN_SERVICE = "Unknown Service"
UNKNOWN_ID = "Unknown ID"
NOT_PROVIDED = "Not provided"
NOT_SPECIFIED = "Not specified"
NO_ID_NUMBER = "-"
NO_INITIAL = "?"
NO_RATING = "0.0"
SOME_CUSTOMER = "A customer"
SOME_SERVICE = "a service"

# Labels and captions.
REJECTED_LABEL = "Rejected due to unavailability"
TOTAL_USERS, LIVE = "Total Users", "Live from DB"
TOTAL_PROVIDERS, ACTIVE = "Total Providers", " active"
TOTAL_BOOKINGS, PENDING = "Total Bookings", " pending"
TOTAL_REVENUE, REAL_TIME = "Total Revenue", "Real-time"
TOTAL_JOBS, LIFETIME = "Total Jobs", "Lifetime jobs"
COMPLETED, FINISHED = "Completed", "Finished tasks"
MONTHLY_EARNINGS, THIS_MONTH = "Monthly Earnings", "Current month"
AVG_RATING, REVIEWS = "Avg Rating", " reviews"

# Notification titles and messages.
NEW_REQUEST = "New Booking Request"
HAS_REQUESTED, ON, AT = " has requested ", " on ", " at "
BOOKING, IS_CURRENTLY = "Booking ", " is currently "

# Formats.
MONEY_SIGN, MONEY_FORMAT, RATING_FORMAT = "₹", "#,##0.###", "0.##"
DAY_FORMAT = "dd/MM/yyyy"
SLOT_FORMAT = "hh:mm a"
BOOKING_PREFIX = "TF-"
