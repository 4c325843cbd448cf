import sys

from hushtable.commands import main

sys.exit(main())
