import sys

from affinis.plans.cli import main

sys.exit(main())
