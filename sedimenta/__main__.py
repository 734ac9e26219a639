"""``python -m sedimenta``."""

import sys

from sedimenta.cli import main

sys.exit(main())
